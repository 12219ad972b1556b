"""Operators for training corpora: de-duplication, tokens, filters, formatting, packing, vector search."""
