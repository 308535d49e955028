"""Operators for preparing training data: text, pages, vectors and recordings at scale."""
