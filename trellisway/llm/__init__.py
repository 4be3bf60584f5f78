"""Training-data operators: ten jobs over documents, pages and embeddings."""
