"""Training-data operators: dedup, filters, mixing, tokenising and scoring of text corpora as Spark jobs."""
