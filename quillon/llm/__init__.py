"""Operators that prepare training data: one module each, independent of the rest of the library."""
