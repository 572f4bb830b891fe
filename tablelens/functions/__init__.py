"""Column expressions: wildcard patterns, line handling, stored widths."""
