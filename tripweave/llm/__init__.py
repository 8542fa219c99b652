"""Operators for preparing training text and vectors; nothing else in the package imports this folder."""
