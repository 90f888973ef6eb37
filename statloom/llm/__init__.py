"""Operators for training corpora: deduplication, mixing, formatting, labelling, extraction and search."""
