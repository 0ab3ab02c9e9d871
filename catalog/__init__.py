"""The registered queries: inputs derived from the given tables, Spark side and SQL side."""
