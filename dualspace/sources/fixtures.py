"""Retrieval-shaped frames derived from the driver tables.

Every derived frame reads the whole source table; rows only take different
roles (chunk, query, gold) by rule, nothing is dropped or capped.

`embeddings` -> pools of chunks and queries (one pool per 50 consecutive
vector ids; one id in 25 acts as a query vector against the other chunks of
its pool; gold support = chunks of the pool carrying the query's label).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dualspace.sources.tables import read_table

# Fixed layout parameters of the embedding-derived fixture.
POOL_WIDTH = 50      # vec_id DIV 50 -> pool_id
QUERY_EVERY = 25     # vec_id % 25 = 0 -> query role


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_vec(pool_id, chunk_idx, label, x ARRAY<DOUBLE>)."""
    e = _embeddings(spark, sf_dir)
    return e.where(F.col("vec_id") % QUERY_EVERY != 0).select(
        F.floor(F.col("vec_id") / POOL_WIDTH).cast("bigint").alias("pool_id"),
        F.col("vec_id").alias("chunk_idx"),
        "label",
        F.col("embedding").cast("array<double>").alias("x"),
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_vec(pool_id, qid, label, q ARRAY<DOUBLE>)."""
    e = _embeddings(spark, sf_dir)
    return e.where(F.col("vec_id") % QUERY_EVERY == 0).select(
        F.floor(F.col("vec_id") / POOL_WIDTH).cast("bigint").alias("pool_id"),
        F.col("vec_id").alias("qid"),
        "label",
        F.col("embedding").cast("array<double>").alias("q"),
    )


def gold_support(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """gold(qid, chunk_idx): chunks of the query's pool sharing its label (equi-join)."""
    return queries.select("pool_id", "qid", "label").join(
        chunks.select("pool_id", "label", "chunk_idx"), ["pool_id", "label"]).select("qid", "chunk_idx")


def all_vectors(spark: SparkSession, sf_dir: str, one_pool: bool = False) -> DataFrame:
    """Every vector as a chunk, for the plans that have no query side: pools of
    POOL_WIDTH ids, or the whole table as one pool (a shared corpus)."""
    pool = F.lit(0) if one_pool else F.floor(F.col("vec_id") / POOL_WIDTH)
    return _embeddings(spark, sf_dir).select(
        pool.cast("bigint").alias("pool_id"), F.col("vec_id").alias("chunk_idx"), "label",
        F.col("embedding").cast("array<double>").alias("x"))


def z_standin(chunks: DataFrame, dims: int = 64) -> tuple[DataFrame, DataFrame]:
    """A supplied structural space with an exact SQL twin, made of whole vectors.

    With `dims` 64, z_k = x[k] - avg_pool(x[k]) for every coordinate (1-based as in SQL);
    with `dims` 2 or 3, the same of the sums of every second or third coordinate.
    lam_k = var_samp_pool of the same. Returns (z(pool_id, chunk_idx, z), lam(pool_id, lam)).
    Pool state is a partial aggregate joined back on pool_id, so a hot pool is
    aggregated map-side instead of landing on one task.
    """
    if dims in (2, 3):
        part = lambda k: F.aggregate(F.filter("x", lambda _, i: i % dims == k), F.lit(0.0), lambda a, v: a + v)
        cols = [part(k).alias(f"x{k + 1}") for k in range(dims)]
    else:
        cols = [F.col("x")[k - 1].alias(f"x{k}") for k in range(1, dims + 1)]
    flat = chunks.select("pool_id", "chunk_idx", *cols)
    stats = flat.groupBy("pool_id").agg(
        *[F.avg(f"x{k}").alias(f"m{k}") for k in range(1, dims + 1)],
        *[F.var_samp(f"x{k}").alias(f"v{k}") for k in range(1, dims + 1)],
    )
    z = flat.join(stats, "pool_id").select(
        "pool_id", "chunk_idx",
        F.array(*[F.col(f"x{k}") - F.col(f"m{k}") for k in range(1, dims + 1)]).alias("z"),
    )
    lam = stats.select("pool_id", F.array(*[F.col(f"v{k}") for k in range(1, dims + 1)]).alias("lam"))
    return z, lam
