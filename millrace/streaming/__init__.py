"""millrace.streaming."""
