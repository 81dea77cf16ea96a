"""Relational, geometric, graph and rule operators (DataFrame in, DataFrame out)."""
