"""Catalog data: fixed values and the small dimension tables built from them."""
