"""Training-data operators: deduplication, scoring, scanning, packing and sharding of a document corpus."""
