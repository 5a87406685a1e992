"""Training-data operators: deduplication, scans, sharding, packing, search, tokenisation and scoring."""
