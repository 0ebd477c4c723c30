"""Training-data operators: quality, near-duplicates, personal data, mixing, tokens, packing, search."""
