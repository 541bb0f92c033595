"""Composed queries over the operators, with their SQL counterparts."""
