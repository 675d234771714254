"""Column functions: identities, text, vectors, scores."""
