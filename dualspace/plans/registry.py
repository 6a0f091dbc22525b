"""The query registry behind ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dualspace.plans import grid_plans, metric_plans, oracle, pca_plans, prompt_plans, report_plans, retrieval, source_plans, store_plans, stream_plans, text_plans, tfidf_plans, traversal_plans


def registered_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for mod in (retrieval, metric_plans, traversal_plans, pca_plans, text_plans, report_plans, source_plans, prompt_plans, tfidf_plans, store_plans, stream_plans, grid_plans):
        out.update(mod.QUERIES)
    return out


def oracle_queries() -> dict[str, str]:
    reg = registered_queries()
    return {k: v for k, v in oracle.SQL.items() if k in reg}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors + two-hop decay traversal (Mahalanobis on the supplied Z) + caps,
    scored per query against the gold support: (qid, n_retrieved, n_gold, recall, precision)."""
    from pyspark.sql import functions as F

    from dualspace.operators import evaluate
    from dualspace.sources.fixtures import chunk_vectors, gold_support, query_vectors
    capped = traversal_plans.q_decay_capped(spark, sf_dir)
    chunks, queries = chunk_vectors(spark, sf_dir), query_vectors(spark, sf_dir)
    pr = evaluate.recall_precision(capped.select("qid", "chunk_idx"), gold_support(chunks, queries), queries)
    return pr.select("qid", "n_retrieved", "n_gold", F.round("recall", 6).alias("recall"),
                     F.round("precision", 6).alias("precision"))
