"""Registered PCA plans (M1-M4, M6) — checked through invariants with exact SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dualspace.functions import vectors as V
from dualspace.operators import decay, pca
from dualspace.operators import metrics as M
from dualspace.plans.common import GAMMA_MAIN, TAU_MAIN, rounded
from dualspace.session import cut_lineage
from dualspace.sources.fixtures import all_vectors, chunk_vectors, query_vectors

TOL = 1e-8


def _max_abs_gram_dev(w: str = "components"):
    W = F.col(w)
    idx = F.sequence(F.lit(0), F.size(W) - 1)
    return F.array_max(F.flatten(F.transform(idx, lambda a: F.transform(
        idx, lambda b: F.abs(V.dot(W[a], W[b]) - F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0)))))))


def q_pca_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = all_vectors(spark, sf_dir)
    fit = pca.fit_pca(x, 8)
    z = pca.project(x, fit)
    d = 8
    means = z.groupBy("pool_id").agg(*[F.avg(F.col("z")[k]).alias(f"m{k}") for k in range(d)])
    centred = F.greatest(*[F.abs(F.col(f"m{k}")) for k in range(d)]) < TOL
    return fit.join(means, "pool_id").select(
        "pool_id", "d_eff", (_max_abs_gram_dev() < TOL).alias("orthonormal"), centred.alias("centred"))


def q_pca_total_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = pca.fit_pca(all_vectors(spark, sf_dir), 64)
    return rounded(fit.select("pool_id", F.aggregate("eigenvalues", F.lit(0.0), lambda a, v: a + v)
                              .alias("total_variance")), "total_variance")


def q_pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = all_vectors(spark, sf_dir)
    z = pca.project(x, pca.fit_pca(x, 64))
    return rounded(z.select("pool_id", "chunk_idx", V.norm("z").alias("znorm")), "znorm")


def q_pca_inv_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, M7 by what they must add up to: the variance kept, and (all components) the mean squared
    Mahalanobis length, n - 1 where n <= D."""
    z, inv = pca.legacy_projector(all_vectors(spark, sf_dir), 64)
    inv = cut_lineage(inv)
    length = F.aggregate(F.zip_with("z", "inv_cov", lambda a, w: a * a * w), F.lit(0.0), lambda s, v: s + v)
    mean = z.join(inv, "pool_id").groupBy("pool_id").agg((F.sum(length) / (F.count(F.lit(1)) - 1)).alias("mahalanobis"))
    kept = inv.select("pool_id", F.aggregate("inv_cov", F.lit(0.0), lambda s, w: s + 1.0 / w - pca.INV_COV_RIDGE).alias("total_variance"))
    return rounded(kept, "total_variance").join(mean.withColumn("mahalanobis", F.round("mahalanobis", 2)), "pool_id")


def q_layout_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, queries = chunk_vectors(spark, sf_dir), query_vectors(spark, sf_dir)
    z, lam, _ = pca.structural_space(chunks, 8)
    space = M.build_space("mahalanobis", z, lam, 8)
    eps = M.calibrate_epsilon(space)
    hops = decay.decay_traversal(chunks, queries, space, eps, TAU_MAIN, GAMMA_MAIN, 2)
    return rounded(pca.layout_2d(chunks, z, hops), "x1", "x2", "z1", "z2", "z0")


QUERIES = {
    "pca_invariants": q_pca_invariants,
    "pca_total_variance": q_pca_total_variance,
    "pca_project": q_pca_project,
    "pca_inv_cov": q_pca_inv_cov,
    "layout_2d": q_layout_2d,
}
