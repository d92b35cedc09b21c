"""Regressors: closed forms in SQL, grouped solvers per fold, whole-history fits."""
