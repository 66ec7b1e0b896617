"""Corpus, graph and event analytics as Spark DataFrame jobs."""
