"""Operators for training-data corpora: text in, decisions per document out."""
