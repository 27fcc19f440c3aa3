"""Operators that prepare text for language models. Nothing outside this package imports it."""
