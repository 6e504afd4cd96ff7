"""Training-data operators: deduplication, sharding, packing, quality and language-model scoring, decontamination."""
