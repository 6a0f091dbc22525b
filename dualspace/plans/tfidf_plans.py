"""Registered TF-IDF plans (E2, E3, R1, V5) over documents and benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dualspace.operators import evaluate, tfidf
from dualspace.plans.common import rounded
from dualspace.sources.tables import read_table


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct document texts keyed by their smallest doc_id."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.groupBy("text").agg(F.min("doc_id").alias("doc_id"))


def _fit(spark, sf_dir):
    """Corpus, its term lists (materialised once: read by fit and transform) and vocabulary."""
    from dualspace.session import cut_lineage
    corpus = cut_lineage(text_corpus(spark, sf_dir))   # read by counts, the document count and transform
    tl = cut_lineage(tfidf.term_lists(corpus))
    return corpus, tl, cut_lineage(tfidf.fit_tfidf(corpus, 256, lists=tl))   # the vocabulary is read for the documents and for the items


def q_tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, tl, vocab = _fit(spark, sf_dir)
    return rounded(tfidf.transform_tfidf(corpus, vocab, lists=tl), "w")


def _retrieval(spark, sf_dir, k=5):
    corpus, tl, vocab = _fit(spark, sf_dir)
    items = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    dv = tfidf.sparse_tfidf(corpus, vocab, lists=tl)
    qv = tfidf.sparse_tfidf(items, vocab, key="item_id")
    top = tfidf.sparse_cosine_topk(qv, dv, k, "item_id", "doc_id")
    return top, items, corpus


def q_tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, _, _ = _retrieval(spark, sf_dir)
    return rounded(top, "score")


def q_tfidf_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, items, corpus = _retrieval(spark, sf_dir)
    gold = tfidf.containment_gold(items, corpus)
    ret = top.select(F.col("item_id").alias("qid"), F.col("doc_id").alias("chunk_idx"))
    g = gold.select(F.col("item_id").alias("qid"), F.col("doc_id").alias("chunk_idx"))
    pr = evaluate.recall_precision(ret, g, items.select(F.col("item_id").alias("qid")))
    return rounded(pr, "recall", "precision")


def q_containment_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return tfidf.containment_gold(items, read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


QUERIES = {
    "tfidf_weights": q_tfidf_weights,
    "tfidf_topk": q_tfidf_topk,
    "tfidf_retrieval": q_tfidf_retrieval,
    "containment_gold": q_containment_gold,
}


def q_lsa_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4/E5 rows-only check: one unit-length (or zero) vector per corpus text."""
    from dualspace.functions import vectors as V
    from dualspace.operators.tfidf import LsaEmbedder
    from dualspace.session import cut_lineage
    corpus = cut_lineage(text_corpus(spark, sf_dir))   # read by the fit and by the embedding
    emb = LsaEmbedder(corpus, 64)
    v = emb.embed(corpus)
    return rounded(v.select("doc_id", F.size("vec").alias("dim"), V.norm(V.as_double_vector("vec")).alias("norm")),
                   "norm")


QUERIES["lsa_embed"] = q_lsa_embed
