"""Training-data operators: scoring, deduplication, filtering, sharding, mixing and tokenisation."""
