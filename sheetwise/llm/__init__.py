"""Operators for preparing training text: cleaning, near-duplicates, mixing, tokens."""
