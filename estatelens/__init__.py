"""Connector-estate analytics as Spark DataFrame operators."""
