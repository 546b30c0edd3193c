"""Training-data operators: deduplication, filters, search, tokenisation, packing."""
