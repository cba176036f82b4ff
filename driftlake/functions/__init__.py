"""Column builders and scalar functions that Spark lacks."""
