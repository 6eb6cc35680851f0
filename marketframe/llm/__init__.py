"""Operators for preparing training data: text, media, pages and vectors."""
