"""loomtrace sources."""
