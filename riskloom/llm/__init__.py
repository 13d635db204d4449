"""Operators for training data at scale, one module each; nothing else in the library imports them."""
