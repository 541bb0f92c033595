"""Relational operators: each is a pure ``DataFrame -> DataFrame`` function."""
