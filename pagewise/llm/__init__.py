"""Training-data operators: cleaning, deduplication, tokenising and scoring of text corpora."""
