"""Registered scoring plans: answer normalisation and scores (V1-V4, P6),
retrieval scores (V5, V6, A1), row normalisation (E1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dualspace.functions import text as T
from dualspace.functions import vectors as V
from dualspace.operators import evaluate, search
from dualspace.plans.common import rounded
from dualspace.sources.answers import answer_pairs
from dualspace.sources.fixtures import chunk_vectors, gold_support, query_vectors
from dualspace.sources.tables import read_table


def q_answer_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    return c.select("conv_id", "turn", T.normalize_answer("text").alias("norm"))


def q_em_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.token_f1(answer_pairs(spark, sf_dir), ["conv_id", "turn"], "pred", "gold"), "f1")


def q_em_f1_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = answer_pairs(spark, sf_dir)
    return rounded(p.select("conv_id", "turn", T.exact_match("pred", "gold").alias("em"),
                            T.f1_score("pred", "gold").alias("f1")), "f1")


def q_answer_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    return c.select("conv_id", "turn", T.clean_answer("text").alias("answer"))


def _naive_scores(spark, sf_dir):
    chunks, queries = chunk_vectors(spark, sf_dir), query_vectors(spark, sf_dir)
    top = search.naive_topk(chunks, queries, 5)
    return evaluate.recall_precision(top, gold_support(chunks, queries), queries)


def q_retrieval_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_naive_scores(spark, sf_dir), "recall", "precision")


def q_retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.overall_means(_naive_scores(spark, sf_dir), ["recall", "precision"]),
                   "mean_recall", "mean_precision")


def q_l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    u = e.select("vec_id", V.l2_normalize(V.as_double_vector("embedding")).alias("u"))
    return rounded(u.select("vec_id", F.aggregate("u", F.lit(0.0), lambda a, t: a + t).alias("vsum"),
                            V.norm("u").alias("vnorm")), "vsum", "vnorm")


QUERIES = {
    "answer_normalize": q_answer_normalize,
    "em_f1": q_em_f1,
    "em_f1_inline": q_em_f1_inline,
    "answer_clean": q_answer_clean,
    "retrieval_pr": q_retrieval_pr,
    "retrieval_summary": q_retrieval_summary,
    "l2_normalize": q_l2_normalize,
}
