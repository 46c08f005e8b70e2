"""Jobs, and the registered queries with their tables and SQL."""
