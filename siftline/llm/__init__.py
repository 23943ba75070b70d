"""Operators that prepare and judge training data. Nothing else in the library imports this."""
