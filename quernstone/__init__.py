"""Passage retrieval, text rules and keyed-state analytics as Spark jobs."""
