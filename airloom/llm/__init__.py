"""Operators for training text and record linkage; nothing else in the library imports this subpackage."""
