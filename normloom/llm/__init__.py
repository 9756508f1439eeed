"""Operators for training data: texts, vectors and free-hand values."""
