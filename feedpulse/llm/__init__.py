"""Training-data operators: filters, dedup, tokens, packing, search, sharding, WARC."""
