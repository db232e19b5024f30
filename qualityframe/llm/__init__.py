"""Operators of a training-data pipeline: tokens, secrets, archives, duplicates, filters."""
