"""Operators for large text collections: language, alignment, segmentation, clean-up, leakage, mixing, statistics."""
