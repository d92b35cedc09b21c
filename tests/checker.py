"""Runs registered queries against their SQL on the given tables.

    python tests/checker.py [folder] [query ...]
"""

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def database(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def normal(pdf):
    """Columns by name, rows in a fixed order, values as text."""
    pdf = pdf[sorted(pdf.columns)]
    out = pd.DataFrame(index=pdf.index)
    for c in pdf.columns:
        v = pdf[c]
        if pd.api.types.is_bool_dtype(v):
            out[c] = v.astype(str)
        elif pd.api.types.is_numeric_dtype(v):
            out[c] = v.astype(float).map(lambda x: "null" if pd.isna(x) else repr(round(x, 9) + 0.0))
        else:
            out[c] = v.map(lambda x: "null" if x is None or x is pd.NaT or x != x else str(x))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def differences(got, want, tolerance=0.0):
    """Empty when equal, else a short description.

    With a tolerance, numbers may differ by the last rounded digit: a value that
    ends in a 5 there is rounded up by one engine and down by the other.
    """
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if tolerance:
        text = [c for c in sorted(got.columns) if not pd.api.types.is_float_dtype(got[c])]
        a, b = (d.sort_values(text).reset_index(drop=True) for d in (got, want))
        for c in got.columns:
            if c in text:
                if (a[c].astype(str) != b[c].astype(str)).any():
                    return f"{c} differs"
            elif not np.allclose(a[c].astype(float), b[c].astype(float), rtol=0, atol=tolerance, equal_nan=True):
                return f"{c} differs"
        return ""
    a, b = normal(got), normal(want)
    bad = {c: int((a[c] != b[c]).sum()) for c in a.columns if (a[c] != b[c]).any()}
    if not bad:
        return ""
    rows = (a != b).any(axis=1)
    return f"{bad}\n{a[rows].head(3).to_string()}\n{b[rows].head(3).to_string()}"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    queries, oracles = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
            spent = time.time() - start
            start = time.time()
            verdict = "no oracle"
            if name in oracles:
                want = con.execute(oracles[name]).df()
                verdict = differences(got, want) or "ok"
            print(f"{name}: {verdict} rows={len(got)} {spent:.1f}s sql {time.time() - start:.1f}s", flush=True)
        except Exception as failure:
            print(f"{name}: FAILED {type(failure).__name__} {str(failure)[:600]}", flush=True)


if __name__ == "__main__":
    main()
