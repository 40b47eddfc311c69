"""loomtrace functions."""
