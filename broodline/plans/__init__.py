"""Named queries (``queries.QUERIES``) and their DuckDB oracle SQL (``oracle_sql``)."""
