"""Operators for training-data corpora: text, pages and media at scale."""
