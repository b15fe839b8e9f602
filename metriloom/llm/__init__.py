"""Operators that prepare text corpora, page archives and embeddings for training."""
