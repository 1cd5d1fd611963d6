"""Semantic search: sparse TF-IDF postings, dense vectors, and rows of a vector store."""
