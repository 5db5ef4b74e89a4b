"""Table operators: each takes a DataFrame and returns a DataFrame (or a small
value that a Spark aggregation produced)."""
