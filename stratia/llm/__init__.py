"""Operators of a training-data pipeline. Nothing else in stratia imports this package."""
