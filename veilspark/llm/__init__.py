"""Training-data operators: near-duplicates, packing, tokens, quality, toxicity, privacy, media."""
