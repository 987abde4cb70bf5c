"""Incremental stacks over event streams."""
