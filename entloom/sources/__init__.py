"""Files in and out: documents, extractions, registry, centroids, gold, review."""
