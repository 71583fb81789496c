"""Retrieval, state and maintenance of scoped text memories as Spark jobs."""
