"""Compositions of operators, the fixture views and the query registry."""
