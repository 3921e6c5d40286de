"""Operators for building training data: secrets, search, decontamination, toxicity, deduplication, formatting, mixing, privacy."""
