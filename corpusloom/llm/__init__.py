"""Large-corpus preparation operators: mixing, deduplication, extraction, packing, filtering."""
