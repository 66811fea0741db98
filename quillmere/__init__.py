"""Spark-first document ingestion, chunking, hybrid retrieval and evaluation."""
