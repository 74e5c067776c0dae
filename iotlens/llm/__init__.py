"""Operators for building training data: language, toxicity, quality, near copies, mixing, tokens."""
