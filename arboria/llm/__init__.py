"""Operators for preparing language-model training data; nothing else of the library imports this."""
