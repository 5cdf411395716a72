"""Training-data operators: token counts, near-duplicates, secrets, language, PII, archives, packing."""
