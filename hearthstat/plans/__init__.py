"""Registered queries: survey roles bound to the given tables, the queries on them, and their SQL twins."""
