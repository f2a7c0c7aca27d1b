"""Column helpers: every function here takes and returns Spark columns."""
