"""Training-data operators: quality, decontamination, PII, WARC, tokens, LM scores, packing, media, toxicity, near-dedup."""
