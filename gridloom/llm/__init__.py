"""Operators of a training-data pipeline over document, vector and conversation tables."""
