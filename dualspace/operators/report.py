"""Report tables over a results log.

Every table is a grouped aggregate: partial aggregation runs map-side, so a
cell holding a third of the rows is pre-aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL4 = ["dataset", "embedder", "metric", "strategy"]
CELL = CELL4 + ["d"]


def _nan_null(c: str):
    return F.when(F.isnan(F.col(c)), F.lit(None)).otherwise(F.col(c))


def table_accuracy(df: DataFrame) -> DataFrame:
    """A2: mean em, f1, judge (NULL skipped) and n per 4-key cell."""
    return (df.groupBy(*CELL4).agg(F.avg("em").alias("em"), F.avg("f1").alias("f1"),
                                   F.avg(_nan_null("judge")).alias("judge"), F.count("qid").alias("n"))
            .orderBy("dataset", "embedder", F.desc("f1")))


def table_retrieval(df: DataFrame) -> DataFrame:
    """A3: mean recall, precision, n_retrieved and n per cell."""
    return (df.groupBy(*CELL4).agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"),
                                   F.avg("n_retrieved").alias("retrieved"), F.count("qid").alias("n"))
            .orderBy("dataset", "embedder", F.desc("recall")))


def table_wallclock(df: DataFrame) -> DataFrame:
    """A4: mean and total wall seconds per cell, largest total first."""
    return (df.groupBy(*CELL4).agg(F.avg("wall_s").alias("mean_wall_s"), F.sum("wall_s").alias("total_wall_s"))
            .orderBy(F.desc("total_wall_s")))


def heatmap_f1(df: DataFrame, embedders: list[str] | None = None) -> DataFrame:
    """A5: metric x embedder mean F1 per dataset (averaged over strategies).
    Passing the embedder list avoids the extra distinct job of `pivot`."""
    g = df.groupBy("dataset", "metric")
    g = g.pivot("embedder", embedders) if embedders is not None else g.pivot("embedder")
    return g.agg(F.avg("f1"))


def bar_f1(df: DataFrame, strategies=("decay", "ppr", "naive", "no_context")) -> DataFrame:
    """Mean F1 by (dataset, metric, strategy) for the listed strategies."""
    return df.where(F.col("strategy").isin(list(strategies))).groupBy("dataset", "metric", "strategy").agg(
        F.avg("f1").alias("f1"))


def scatter_recall_f1(df: DataFrame, strategies=("decay", "ppr", "naive")) -> DataFrame:
    """One (recall, f1) point per cell of the listed strategies."""
    return df.where(F.col("strategy").isin(list(strategies))).groupBy(*CELL4).agg(
        F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def dim_ablation(df: DataFrame, strategies=("decay", "ppr")) -> DataFrame:
    """Best (embedder, metric) by mean F1 for every d, first on ties;
    empty when the log holds a single d."""
    n_d = df.select(F.countDistinct("d")).scalar()  # scalar subquery, no join
    g = df.where(F.col("strategy").isin(list(strategies))).groupBy("d", "embedder", "metric").agg(
        F.avg("f1").alias("f1"))
    best = g.withColumn("_r", F.row_number().over(
        Window.partitionBy("d").orderBy(F.desc("f1"), "embedder", "metric"))).where(F.col("_r") == 1)
    return best.where(n_d > 1).select("d", "embedder", "metric", "f1")


def exec_summary(df: DataFrame) -> DataFrame:
    """Per dataset the best cell by mean F1 and by mean judge (first on ties
    in key order), and the naive / no-context mean F1 (NULL when absent)."""
    g = df.groupBy("dataset", "embedder", "metric", "strategy").agg(
        F.avg("f1").alias("f1"), F.avg(_nan_null("judge")).alias("judge"), F.count("qid").alias("n"))
    keys = ["embedder", "metric", "strategy"]
    bf = g.withColumn("_r", F.row_number().over(
        Window.partitionBy("dataset").orderBy(F.desc("f1"), *keys))).where("_r = 1")
    bj = g.where(F.col("judge").isNotNull()).withColumn("_r", F.row_number().over(
        Window.partitionBy("dataset").orderBy(F.desc("judge"), *keys))).where("_r = 1")
    label = F.concat_ws(" + ", *keys)
    base = df.groupBy("dataset").agg(
        F.avg(F.when(F.col("strategy") == "naive", F.col("f1"))).alias("naive_baseline_f1"),
        F.avg(F.when(F.col("strategy") == "no_context", F.col("f1"))).alias("no_context_baseline_f1"))
    return (base.join(bf.select("dataset", label.alias("best_by_f1"), F.col("f1").alias("best_f1"),
                                F.col("n").alias("best_f1_n")), "dataset", "left")
            .join(bj.select("dataset", label.alias("best_by_judge"), F.col("judge").alias("best_judge")),
                  "dataset", "left"))


def report_meta(df: DataFrame) -> DataFrame:
    """A10: distinct questions, rows, and the sorted distinct value lists."""
    j = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return df.agg(F.countDistinct("qid").alias("questions"), F.count(F.lit(1)).alias("rows"),
                  j("dataset").alias("datasets"), j("embedder").alias("embedders"),
                  j("metric").alias("metrics"), j("strategy").alias("strategies"),
                  F.array_join(F.transform(F.array_sort(F.collect_set("d")), lambda x: x.cast("string")), ",")
                  .alias("dims"))


def gallery(df: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """N questions drawn by a seeded hash among decay/ppr rows, then every
    row of those questions with 300/200-character previews (V7)."""
    qids = df.where(F.col("strategy").isin("decay", "ppr")).select("qid").distinct()
    pick = qids.withColumn("_h", F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col("qid")))).orderBy(
        "_h", "qid").limit(n).select("qid")
    return df.join(F.broadcast(pick), "qid").select(
        "qid", "query", "gold_answer", *CELL4,
        F.substring("predicted", 1, 300).alias("predicted_preview"),
        F.substring("judge_rationale", 1, 200).alias("rationale_preview"),
        "f1", "em", "judge")


def cell_summary(df: DataFrame) -> DataFrame:
    """Per 5-key cell mean f1, em, judge (NULL counted as 0), recall, n_retrieved."""
    return df.groupBy(*CELL).agg(
        F.avg("f1").alias("mean_f1"), F.avg("em").alias("mean_em"),
        F.avg(F.coalesce(_nan_null("judge"), F.lit(0.0))).alias("mean_judge"),
        F.avg("recall").alias("mean_recall"), F.avg("n_retrieved").alias("mean_retrieved"),
        F.count(F.lit(1)).alias("n"))


def _measures(df: DataFrame, *extra) -> DataFrame:
    return df.select(*CELL, "f1", F.coalesce(_nan_null("judge"), F.lit(0.0)).alias("_j"),
                     F.col("n_retrieved").cast("double").alias("_r"), *extra)


def _totals(x: DataFrame, *keys: str) -> DataFrame:
    return x.groupBy(*CELL, *keys).agg(F.count(F.lit(1)).alias("_tn"), F.sum("f1").alias("_tf"),
                                       F.sum("_j").alias("_tj"), F.sum("_r").alias("_tr"))


TOTALS = ("_tn", "_tf", "_tj", "_tr")


def running_totals(df: DataFrame) -> DataFrame:
    """What running_means takes as `earlier`: per 5-key cell the count and the sums of its records."""
    return _totals(_measures(df))


def running_means(df: DataFrame, order: str = "seq", block: int = 65536, earlier: DataFrame | None = None) -> DataFrame:
    """G5 (batch twin): running mean of f1, judge (NULL as 0) and n_retrieved per
    5-key cell in `order` order; `earlier` holds the totals of records that came before all of `df`.

    Skew-safe prefix sums: rows are cut into `order` ranges of `block`; each
    range is summed (map-side partial aggregate), the few range totals get an
    exclusive running sum per cell, and the in-range running sums are windows
    over (cell, range) — no cell is ever sorted in a single task."""
    x = _measures(df, order, F.floor(F.col(order) / block).alias("_b"))
    tot = _totals(x, "_b")
    if earlier is not None:
        tot = tot.unionByName(earlier.select(*CELL, F.lit(-(1 << 62)).alias("_b"), *TOTALS))
    before = Window.partitionBy(*CELL).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*CELL, "_b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_o{c[2:]}")
                                    for c in TOTALS])
    w = Window.partitionBy(*CELL, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    j = x.join(off, CELL + ["_b"])
    n = F.col("_on") + F.count(F.lit(1)).over(w)
    return j.select(*CELL, order,
                    ((F.col("_of") + F.sum("f1").over(w)) / n).alias("running_f1"),
                    ((F.col("_oj") + F.sum("_j").over(w)) / n).alias("running_judge"),
                    ((F.col("_or") + F.sum("_r").over(w)) / n).alias("running_retrieved"))
