"""loomtrace operators."""
