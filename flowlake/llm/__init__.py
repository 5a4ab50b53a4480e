"""Training-data operators: extraction, filtering, deduplication, mixing and sharding of text corpora."""
