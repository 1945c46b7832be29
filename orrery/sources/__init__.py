"""Readers of count matrices, labels and metadata, and strict writers."""
