"""Table and graph sources."""
