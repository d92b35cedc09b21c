"""Time-series features and walk-forward evaluation on Spark."""

from tideline.operators.layout import Series, lay_out
from tideline.operators.metrics import evaluate
from tideline.operators.quality import column_statistics, table_summary
from tideline.operators.sequences import create_sequences
from tideline.plans.backtest import evaluate_models, final_models
from tideline.plans.features import (
    create_calendar_features,
    create_features,
    create_interaction_features,
    create_lagged_features,
    create_returns_and_volatility,
    create_rolling_features,
    create_rolling_statistics,
    create_target_variable,
    create_technical_indicators,
    feature_set,
    feature_sets,
)
from tideline.plans.run import apply_models, run_path
from tideline.sources.readers import load_data, read_table

__all__ = [
    "Series",
    "apply_models",
    "column_statistics",
    "create_calendar_features",
    "create_features",
    "create_interaction_features",
    "create_lagged_features",
    "create_returns_and_volatility",
    "create_rolling_features",
    "create_rolling_statistics",
    "create_sequences",
    "create_target_variable",
    "create_technical_indicators",
    "evaluate",
    "evaluate_models",
    "feature_set",
    "feature_sets",
    "final_models",
    "lay_out",
    "load_data",
    "read_table",
    "run_path",
    "table_summary",
]
