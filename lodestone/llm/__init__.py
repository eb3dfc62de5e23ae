"""Operators that prepare text and embeddings for training language models.

Nothing outside this subpackage imports it.
"""
