"""Operators for building training corpora from documents."""
