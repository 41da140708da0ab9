"""Functions that Spark has no built-in for: exact quantiles of huge groups, and user-defined forms over Arrow."""
