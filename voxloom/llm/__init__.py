"""Operators on records, vectors and texts for training data; nothing else in the library imports this."""
