"""Spark jobs that prepare, serve, score and describe text corpora."""
