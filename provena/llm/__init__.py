"""Operators of a training-data pipeline over raw texts, pages and vectors."""
