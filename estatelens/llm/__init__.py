"""Operators of a training-data pipeline: scoring, filtering, de-duplication, packing."""
