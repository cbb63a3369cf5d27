"""Operators for preparing training data, one module each; nothing outside imports them."""
