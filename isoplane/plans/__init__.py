"""Composed query plans, each a lazy DataFrame over the driver tables."""
