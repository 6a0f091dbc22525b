"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dualspace.session import checkpoint_dir, shuffles_freed


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: lineage ends there, so a lost
    executor costs a re-read and never a recomputation."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_checked(df: DataFrame, max_rows: int) -> DataFrame:
    """`df` with a broadcast hint only if it has at most `max_rows` rows; beyond
    that Spark joins by a shuffle. `df` should be cheap to read again."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or if `df` has a column of that name (in any case), the name with as many underscores before it as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
