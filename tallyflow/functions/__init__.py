"""Column helpers: every one returns a built-in Spark expression, none is a UDF."""
