"""Ranked-retrieval analytics on Spark."""
