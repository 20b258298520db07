"""The registered queries: each a Spark callable and, where SQL can say it, a DuckDB twin."""
