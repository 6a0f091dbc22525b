"""A results log shaped like the runner's output, derived from `events`.

Every event row becomes one (cell, question) record; all measures are dyadic
fractions so sums are exact in any order. Duplicate (cell, qid) rows occur by
design (re-runs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dualspace.sources.tables import read_table

# Result record schema (one row per cell x question), fixed field order.
RESULT_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("embedder", T.StringType()),
    T.StructField("metric", T.StringType()), T.StructField("strategy", T.StringType()),
    T.StructField("d", T.IntegerType()), T.StructField("qid", T.StringType()),
    T.StructField("query", T.StringType()), T.StructField("gold_answer", T.StringType()),
    T.StructField("predicted", T.StringType()),
    T.StructField("em", T.DoubleType()), T.StructField("f1", T.DoubleType()),
    T.StructField("recall", T.DoubleType()), T.StructField("precision", T.DoubleType()),
    T.StructField("judge", T.DoubleType(), True), T.StructField("judge_rationale", T.StringType()),
    T.StructField("retrieved_ids", T.ArrayType(T.IntegerType())),
    T.StructField("primary_ids", T.ArrayType(T.IntegerType())),
    T.StructField("structural_ids", T.ArrayType(T.IntegerType())),
    T.StructField("gold_support_ids", T.ArrayType(T.IntegerType())),
    T.StructField("n_retrieved", T.IntegerType()), T.StructField("wall_s", T.DoubleType()),
])

CELL = ["dataset", "embedder", "metric", "strategy", "d"]


def results_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events", ["event_id", "event_type", "props"])
    i = F.col("event_id")
    div = lambda a, b: F.floor(a / b).cast("bigint")
    metric = (F.when(div(i, 4) % 4 == 2, "cosine_x").when(div(i, 4) % 4 == 3, "none")
              .when(div(i, 16) % 3 == 0, "mahalanobis").when(div(i, 16) % 3 == 1, "euclidean").otherwise("rbf"))
    strategy = (F.when(div(i, 4) % 4 == 0, "decay").when(div(i, 4) % 4 == 1, "ppr")
                .when(div(i, 4) % 4 == 2, "naive").otherwise("no_context"))
    judge = F.when(i % 10 == 0, F.lit(None).cast("double")).when(i * 7 % 3 == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return e.select(
        F.concat(F.lit("ds"), (i % 2).cast("string")).alias("dataset"),
        F.concat(F.lit("emb"), (div(i, 2) % 2).cast("string")).alias("embedder"),
        metric.alias("metric"), strategy.alias("strategy"),
        F.when(div(i, 48) % 2 == 0, 8).otherwise(16).cast("int").alias("d"),
        div(i, 96).cast("string").alias("qid"),
        F.concat(F.lit("question "), div(i, 96).cast("string")).alias("query"),
        F.col("event_type").alias("gold_answer"),
        F.col("props").alias("predicted"),
        ((i * 37 % 129) / F.lit(128.0)).alias("f1"),
        F.when(i * 37 % 129 == 128, 1.0).otherwise(0.0).alias("em"),
        ((i * 53 % 5) / F.lit(4.0)).alias("recall"),
        ((i * 29 % 9) / F.lit(8.0)).alias("precision"),
        judge.alias("judge"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("judge_rationale"),
        (i * 13 % 16).cast("int").alias("n_retrieved"),
        ((i * 11 % 257) / F.lit(64.0)).alias("wall_s"),
        i.alias("seq"),
    )
