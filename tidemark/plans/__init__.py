"""The registered queries: operators applied to the given tables, each beside the SQL of the same result."""
