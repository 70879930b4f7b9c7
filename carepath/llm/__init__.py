"""Training-data operators: quality, deduplication, mixing, tokens, archives, extraction, labels."""
