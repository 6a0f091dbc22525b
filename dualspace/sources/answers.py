"""Answer pairs derived from `conversations` (whole table, whole texts):
gold = a user turn, pred = the assistant turn that follows it, or the empty
answer where none does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dualspace.sources.tables import read_table


def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("gold"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    return u.join(a, ["conv_id", "turn"], "left").withColumn("pred", F.coalesce("pred", F.lit("")))
