"""Registered loader plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dualspace.sources import qa


def _with_gold(chunks: DataFrame, gold: DataFrame) -> DataFrame:
    g = gold.select(F.col("qid").alias("pool_id"), "chunk_idx", F.lit(True).alias("is_gold"))
    return chunks.join(g, ["pool_id", "chunk_idx"], "left").select(
        "pool_id", "chunk_idx", "title", "text", F.coalesce("is_gold", F.lit(False)).alias("is_gold"))


def q_qa_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, chunks, gold = qa.load_benchmark("struct_of_arrays", spark, sf_dir)
    return _with_gold(chunks, gold)


def q_qa_pools_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, chunks, gold = qa.load_benchmark("array_of_pairs", spark, sf_dir)
    return _with_gold(chunks, gold)


def q_question_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five seeded questions of each loader, with the number of their gold chunks."""
    out = None
    for name in qa.LOADERS:
        questions, _, gold = qa.load_benchmark(name, spark, sf_dir, n=5, seed=42)
        n_gold = gold.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"))
        part = questions.join(n_gold, "qid", "left").select(
            F.lit(name).alias("loader"), "qid", "query", F.coalesce("n_gold", F.lit(0)).cast("long").alias("n_gold"))
        out = part if out is None else out.unionByName(part)
    return out


def q_shared_corpus_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared-corpus loader: every question with its answer and its gold chunks."""
    questions, chunks, gold = qa.load_benchmark("shared_corpus", spark, sf_dir)
    g = gold.join(questions.select("qid", "pool_id", "query", "gold_answer"), "qid").join(chunks, ["pool_id", "chunk_idx"])
    return g.select("qid", "pool_id", "query", "gold_answer", "chunk_idx", "title", F.length("text").cast("long").alias("chars"))


def q_evidence_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = qa.page_corpus(spark, sf_dir)
    return qa.link_evidence(qa.evidence_queries(spark, sf_dir, corpus), corpus)


QUERIES = {
    "qa_pools": q_qa_pools,
    "qa_pools_pairs": q_qa_pools_pairs,
    "question_sample": q_question_sample,
    "shared_corpus_pool": q_shared_corpus_pool,
    "evidence_link": q_evidence_link,
}
