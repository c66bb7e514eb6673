"""Readers that turn exported tables and documents into plain DataFrames."""
