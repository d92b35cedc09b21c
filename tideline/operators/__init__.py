"""DataFrame operators: series layout, features, folds, metrics, reports."""
