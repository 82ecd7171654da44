"""Training-data operators: near and exact deduplication, mixing, toxicity, sharding, PII, HTML extraction, packing."""
