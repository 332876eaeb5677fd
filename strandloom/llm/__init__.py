"""Corpus preparation: dedup, filtering, classifiers, mixing and packing for training data."""
