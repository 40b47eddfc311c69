"""loomtrace streaming."""
