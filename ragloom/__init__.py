"""Retrieval analytics on Spark: ingest, chunk, index, search, rerank, answer and evaluate, in batches."""

__version__ = "0.1.0"
