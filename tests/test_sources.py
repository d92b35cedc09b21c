import logging

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException

from frames import to_spark, walk
from tideline.operators import quality, sequences
from tideline.operators.layout import Series
from tideline.plans.features import feature_set
from tideline.sources import readers, sinks


def write(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_load_renames_and_types(spark, tmp_path):
    path = write(tmp_path, "time,gold,other\n1987-01-01,1.5,NaN\n2025-05-28,,3\n")
    df = readers.load_data(spark, path)
    assert df.columns == ["time", "Gold_Price_USD", "other"]
    rows = df.orderBy("time").collect()
    assert rows[0].Gold_Price_USD == 1.5 and rows[0].other is None and rows[1].other == 3.0


def test_load_reports_nulls_and_dates_but_keeps_rows(spark, tmp_path, caplog):
    path = write(tmp_path, "time,gold\n1990-01-01,\n1990-01-02,2\n")
    with caplog.at_level(logging.WARNING):
        df = readers.load_data(spark, path)
    assert df.count() == 2
    assert "not as expected" in caplog.text and "1 nulls" in caplog.text
    assert readers.coverage(df).first().in_range is False


def test_load_failures(spark, tmp_path):
    with pytest.raises(ValueError, match="Gold_Price_USD"):
        readers.load_data(spark, write(tmp_path, "time,Other_Col\n2020-01-01,1\n"))
    with pytest.raises(TypeError):
        readers.require_time(spark.createDataFrame([("x",)], "time string"))
    with pytest.raises(AnalysisException):
        readers.load_data(spark, str(tmp_path / "missing.csv"))


def test_text_is_kept_or_reported(spark, tmp_path, caplog):
    path = write(tmp_path, "time,series_id,price\n2020-01-01,A,1\n2020-01-02,B,NaN\n2020-01-03,B,\n")
    rows = readers.read_table(spark, path, keys=["series_id"]).orderBy("time").collect()
    assert [r.series_id for r in rows] == ["A", "B", "B"] and [r.price for r in rows] == [1.0, None, None]
    with pytest.raises(ValueError, match="series_id"):
        readers.read_table(spark, path)
    with caplog.at_level(logging.WARNING):
        assert readers.read_table(spark, path, lost="report").filter("series_id IS NULL").count() == 3
    assert "3 cells" in caplog.text


def test_folders_without_a_telling_name(spark, tmp_path):
    spark.createDataFrame([(1.0, "a")], "price double, k string").write.partitionBy("k").parquet(str(tmp_path / "p"))
    assert readers.read_table(spark, str(tmp_path / "p")).first().price == 1.0
    write(tmp_path, "time,gold\n2020-01-01,2\n", "plain")
    made = readers.load_data(spark, str(tmp_path / "plain"), series_id="one").first()
    assert made.series_id == "one" and made.Gold_Price_USD == 2.0


def test_duplicate_times(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1)], "series_id string, time int")
    assert [tuple(r) for r in quality.duplicate_times(df).collect()] == [("a", 1, 2)]


def test_parquet_source_turns_nan_into_null(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(float("nan"),), (1.0,)], "price double").write.parquet(path)
    assert readers.read_table(spark, path).filter("price IS NULL").count() == 1


def test_quality_report(spark):
    pdf = walk(50, 1, "a", nulls=[(3, 5)])
    df = to_spark(spark, pdf)
    summary = quality.table_summary(df).first()
    assert (summary.total_rows, summary.total_columns) == (50, 5)
    got = quality.column_statistics(df).toPandas().set_index("column")
    want = pdf[["price", "cov1", "cov2"]].describe()
    for c in want.columns:
        assert got.loc[c, "nulls"] == pdf[c].isna().sum()
        for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                             ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")):
            assert got.loc[c, ours] == pytest.approx(want.loc[theirs, c])


def test_row_checks(spark):
    pdf = walk(40, 1, "a").drop(index=[10, 11, 12]).reset_index(drop=True)
    pdf.loc[20, "price"] = 1e6
    df = to_spark(spark, pdf)
    for series in (Series(), Series(chunk_rows=10)):
        gaps = quality.time_gaps(df, 1, series).collect()
        assert [r.gap_days for r in gaps] == [4]
    flagged = quality.outliers(df, "price").filter("is_outlier").collect()
    assert max((r.price, r.z_score) for r in flagged) > (1e6 - 1, 3)
    assert quality.range_violations(df, {"price": (0, 1000)}).first()[0] == 1


@pytest.mark.parametrize("series", [Series(), Series(chunk_rows=7)], ids=["whole", "cut"])
def test_sequences(spark, series):
    pdf = walk(20, 1, "s")
    pdf["price"] = np.arange(1.0, 21.0)
    df = to_spark(spark, pdf)
    made = sequences.create_sequences(df, "price", 5, series).orderBy("time").collect()
    assert len(made) == 15 and made[0].sequence == [1, 2, 3, 4, 5] and made[0].y == 6
    assert sequences.create_sequences(df, "price", 20, series).count() == 0
    first, second = df.filter("price <= 15"), df.filter("price > 15")
    held = sequences.test_sequences(first, second, "price", 5, series).orderBy("time").collect()
    assert [r.y for r in held] == [16, 17, 18, 19, 20] and held[0].sequence == [11, 12, 13, 14, 15]


def test_min_max_uses_train_limits_and_inverts(spark):
    df = to_spark(spark, pd.concat([walk(30, 1, "a"), walk(30, 2, "b")]))
    train = df.filter("time < '2020-01-20'")
    limits = sequences.fit_min_max(train, "price", ["series_id"])
    scaled = sequences.min_max(df, limits, "price", ["series_id"])
    inside = scaled.filter("time < '2020-01-20'").agg({"price_scaled": "max"}).first()[0]
    assert inside == 1.0
    back = sequences.inverse_min_max(scaled, limits, "price_scaled", ["series_id"])
    assert back.filter("abs(price - price_scaled_restored) > 1e-9").count() == 0


def test_feature_table_is_split_by_lookback(spark, tmp_path):
    df = to_spark(spark, walk(120, 1, "a"))
    path = str(tmp_path / "features")
    sinks.write_feature_sets([feature_set(df, "price", 21)], path)
    back = spark.read.parquet(path).filter("lookback = 21")
    assert back.count() > 42 and "x" in back.columns
    assert "PartitionFilters: [isnotnull(lookback" in back._jdf.queryExecution().toString()
