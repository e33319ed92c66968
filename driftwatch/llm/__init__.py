"""Operators for text corpora that train language models. Nothing else in the library imports this package."""
