"""loomtrace plans."""
