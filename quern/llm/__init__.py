"""Training-data operators: sharding, filtering, tokens, quality, near-duplicates, mixing."""
