"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one only for a local session."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tideline-checkpoint-")
    context.setCheckpointDir(named)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder; later uses read it back."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{tag}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder, a folder per value of ``by``, and read it back."""
    path = scratch_folder(df.sparkSession, "rows")
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
