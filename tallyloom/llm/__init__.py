"""Operators on training text: packing, leakage of test items, truncated records."""
