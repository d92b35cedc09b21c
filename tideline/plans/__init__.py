"""Compositions of operators: feature sets, walk-forward evaluation, queries."""
