"""Two-participant pose-track analytics as Spark plans."""
