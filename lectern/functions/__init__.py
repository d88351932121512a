"""Column functions on text, time and paths."""
