"""Registered retrieval plans over the embedding fixture (R*, W*, V5/V6, A1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dualspace.operators import search
from dualspace.plans.common import TAU_ALT, TAU_MAIN, rounded
from dualspace.sources.fixtures import chunk_vectors, query_vectors


def q_naive_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = search.naive_topk(chunk_vectors(spark, sf_dir), query_vectors(spark, sf_dir), k=5)
    return rounded(df, "sim")


def q_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = search.anchors(chunk_vectors(spark, sf_dir), query_vectors(spark, sf_dir), tau=TAU_MAIN, min_anchors=3)
    return rounded(df, "dx")


def q_anchors_tau070(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = search.anchors(chunk_vectors(spark, sf_dir), query_vectors(spark, sf_dir), tau=TAU_ALT, min_anchors=3)
    return rounded(df, "dx")


def q_strict_start_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = search.strict_start_set(chunk_vectors(spark, sf_dir), query_vectors(spark, sf_dir), tau=TAU_MAIN)
    return rounded(df, "dx")


QUERIES = {
    "naive_topk": q_naive_topk,
    "anchors": q_anchors,
    "anchors_tau070": q_anchors_tau070,
    "strict_start_set": q_strict_start_set,
}
