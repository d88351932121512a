"""Text and timeline analytics as PySpark DataFrame functions."""
