"""Experiments composed of operators, their test inputs, and the query registry."""
