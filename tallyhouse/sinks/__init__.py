"""Places that results are written to."""
