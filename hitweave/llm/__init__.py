"""Operators of a training-data pipeline over text, page and benchmark tables."""
