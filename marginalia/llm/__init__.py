"""Operators for large text corpora: tokenizing, language, quality, duplicates, packing and scoring."""
