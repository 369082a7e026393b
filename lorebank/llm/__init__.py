"""Operators for preparing training data; each module holds one operator and its method."""
