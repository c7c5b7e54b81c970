"""Column functions: hashes, vectors, text, chunks, scores, and the embedding seam."""
