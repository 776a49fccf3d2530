"""Training-data operators: deduplication, scans, packing, token output and media columns on Spark."""
