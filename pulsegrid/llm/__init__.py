"""Operators for training-data pipelines over text and event records; nothing else in the package imports this."""
