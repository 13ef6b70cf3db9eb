"""millrace.sources."""
