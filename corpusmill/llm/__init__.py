"""Operators that prepare a corpus for training language models. Nothing else in the library imports this."""
