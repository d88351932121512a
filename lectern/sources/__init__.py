"""Readers of markup, sidecar, audio-header and catalogue files, and writers."""
