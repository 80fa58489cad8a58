"""Training-data operators: near-duplicate search, filtering, tokenising and packing of text."""
