"""Corpus operators for training data: clean, filter, deduplicate, score, pack."""
