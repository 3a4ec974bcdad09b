"""Operators for preparing training data: cleaning, deduplication, scoring, tokenizing and packing of documents."""
