"""Registered vector-store plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dualspace.operators import store
from dualspace.session import checkpoint_dir
from dualspace.sources import qa
from dualspace.sources.tables import read_table

MODEL, DIM, TASK = "tfidf", 64, "RETRIEVAL_DOCUMENT"


def q_vector_store_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misses of all document texts against a store holding the labelled documents."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    lab = read_table(spark, sf_dir, "labels", ["doc_id"])
    req = d.select(store.content_key("text", MODEL, DIM, TASK).alias("key"), "text")
    stored = d.join(lab, "doc_id", "left_semi").select(store.content_key("text", MODEL, DIM, TASK).alias("key"))
    return store.misses(req, stored).select("key", F.length("text").alias("chars"))


def q_vector_store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two get_or_compute rounds (labelled documents, then all) into a fresh store
    in the session's shared checkpoint folder; every distinct text stored once."""
    from dualspace.operators.tfidf import LsaEmbedder
    from dualspace.plans.tfidf_plans import text_corpus
    path = f"{checkpoint_dir(spark).rstrip('/')}/vector-store-{uuid.uuid4().hex}"
    vs = store.VectorStore(spark, path)
    emb = LsaEmbedder(text_corpus(spark, sf_dir), DIM)

    def compute(todo: DataFrame) -> DataFrame:
        return emb.embed(todo.select("key", "text"), key="key")

    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    lab = read_table(spark, sf_dir, "labels", ["doc_id"])
    vs.get_or_compute(d.join(lab, "doc_id", "left_semi"), MODEL, DIM, TASK, compute).count()
    vs.get_or_compute(d, MODEL, DIM, TASK, compute).count()
    return vs.stats()


def q_corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, chunks, _ = qa.load_benchmark("struct_of_arrays", spark, sf_dir)
    return store.corpus_fingerprint(chunks)


def q_corpus_fingerprint_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, chunks, _ = qa.load_benchmark("struct_of_arrays", spark, sf_dir)
    return store.corpus_fingerprint_reference(chunks)


QUERIES = {
    "vector_store_misses": q_vector_store_misses,
    "vector_store_stats": q_vector_store_stats,
    "corpus_fingerprint": q_corpus_fingerprint,
    "corpus_fingerprint_reference": q_corpus_fingerprint_reference,
}
