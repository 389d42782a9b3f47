"""Training-data operators: scoring, filtering, deduplication, mixing and packing of text corpora on Spark."""
