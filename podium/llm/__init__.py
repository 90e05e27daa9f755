"""Training-data operators: filtering, deduplication, decontamination and tokenising of text corpora."""
