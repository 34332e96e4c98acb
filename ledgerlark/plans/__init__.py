"""Registered queries: canonical views over the driver's tables, the queries on them, and their SQL."""
