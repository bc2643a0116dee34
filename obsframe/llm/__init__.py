"""Operators for training-data pipelines over documents, embeddings and benchmark items."""
