"""Composed jobs: ingestion, routing and retrieval."""
