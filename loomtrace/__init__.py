"""loomtrace: log, call-graph and sequence analytics written as Spark plans."""

__version__ = "0.1.0"
