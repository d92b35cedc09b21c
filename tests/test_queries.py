"""Registered queries against SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

from checker import database, differences

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as e  # noqa: E402

SMALL = "/root/testdata/sf0.001"
CHECKED = [
    "table_summary", "null_counts", "lags", "rolling_quantiles", "rolling_moments", "cut_rolling",
    "strength_index", "cut_exponential_average", "exponential_average_with_gaps", "padded_momentum",
    "return_risk", "rolling_correlation", "calendar", "targets", "cut_fold_sizes", "fold_scaling",
    "cut_autoregression", "held_out_sequences", "walk_forward_report",
]


@pytest.fixture(scope="module")
def tables():
    if not Path(SMALL).is_dir():
        pytest.skip("the given tables are not here")
    return database(SMALL)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, tables, name):
    got = e.queries()[name](spark, SMALL).toPandas()
    assert len(got)
    assert differences(got, tables.execute(e.oracle_sql()[name]).df(), 1.5e-6) == ""


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_has_rows(spark):
    assert e.entry(spark).count() == 3
