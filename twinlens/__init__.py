"""Synthetic tables made, sanitised and judged as Spark jobs."""
