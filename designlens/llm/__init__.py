"""Operators for preparing training text at large scale."""
