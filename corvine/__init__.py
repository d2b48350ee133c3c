"""A Spark engine for retrieval over source code."""
__version__ = "0.2.0"
