"""Registered Z-metric plans (D1-D11) over the supplied structural space."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dualspace.operators import metrics as M
from dualspace.plans.common import rounded
from dualspace.sources.fixtures import QUERY_EVERY, all_vectors, z_standin

EPS_SEED = 42     # cell seed that reaches epsilon calibration
EPS_SAMPLE = 50
KNN_BLOCK = 1024
Z_DIMS = 64     # every coordinate of the embeddings
Z_DIMS_BHAT = 2  # two sums over all coordinates: SQL can invert 2 x 2 covariances


def _space(spark: SparkSession, sf_dir: str, metric: str, dims: int = Z_DIMS) -> M.MetricSpace:
    z, lam = z_standin(all_vectors(spark, sf_dir), dims)
    return M.build_space(metric, z, lam, dims)


def q_dist(metric: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from the query rows (one id in QUERY_EVERY) to every other row of their pools."""
    dims = Z_DIMS_BHAT if metric == "bhattacharyya" else Z_DIMS
    refs = all_vectors(spark, sf_dir).where(F.col("chunk_idx") % QUERY_EVERY == 0)
    return rounded(M.reference_distances(_space(spark, sf_dir, metric, dims), refs), "d")


def q_rbf_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, _ = z_standin(all_vectors(spark, sf_dir), Z_DIMS)
    return rounded(M.rbf_gamma(z).withColumnRenamed("s", "gamma"), "gamma")


def q_epsilon_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, lam = z_standin(all_vectors(spark, sf_dir), Z_DIMS)
    eps = M.calibrate_epsilons(z, lam, ["mahalanobis", "euclidean", "cosine", "dot", "rbf"], 0.10, EPS_SAMPLE, EPS_SEED)
    return rounded(eps, "epsilon")


def q_knn_graph(one_pool: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    z, _ = z_standin(all_vectors(spark, sf_dir, one_pool), Z_DIMS)
    return rounded(M.knn_graph(z, M.BHAT_K, KNN_BLOCK), "d2")


def q_one_pool_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as one pool: the 50- and 200-point samples are real samples."""
    z, lam = z_standin(all_vectors(spark, sf_dir, True), Z_DIMS)
    eps = M.calibrate_epsilons(z, lam, ["mahalanobis", "euclidean", "cosine", "dot", "rbf"], 0.10, EPS_SAMPLE, EPS_SEED)
    gamma = M.rbf_gamma(z).select("pool_id", F.lit("gamma").alias("metric"), F.col("s").alias("epsilon"))
    return rounded(eps.unionByName(gamma), "epsilon")


def q_local_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, lam = z_standin(all_vectors(spark, sf_dir), Z_DIMS_BHAT)
    lc = M.local_covariance(z, lam, Z_DIMS_BHAT)
    df = lc.select("pool_id", "chunk_idx", F.col("cov")[0].alias("c11"), F.col("cov")[1].alias("c12"),
                   F.col("cov")[3].alias("c22"), "logdet")
    return rounded(df, "c11", "c12", "c22", "logdet")


def q_local_cov_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper triangle of each local covariance over three sums of coordinates."""
    z, lam = z_standin(all_vectors(spark, sf_dir), 3)
    at = {f"c{r + 1}{c + 1}": F.col("cov")[3 * r + c] for r in range(3) for c in range(r, 3)}
    df = M.local_covariance(z, lam, 3).select("pool_id", "chunk_idx", *[v.alias(k) for k, v in at.items()], "logdet")
    return rounded(df, *at, "logdet")


def q_dist_bhattacharyya_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from every row to every other row of its pool."""
    return rounded(M.reference_distances(_space(spark, sf_dir, "bhattacharyya", 3), all_vectors(spark, sf_dir)), "d")


QUERIES = {
    "dist_cosine": partial(q_dist, "cosine"),
    "dist_euclidean": partial(q_dist, "euclidean"),
    "dist_mahalanobis": partial(q_dist, "mahalanobis"),
    "dist_dot": partial(q_dist, "dot"),
    "dist_rbf": partial(q_dist, "rbf"),
    "dist_bhattacharyya_2d": partial(q_dist, "bhattacharyya"),
    "rbf_gamma": q_rbf_gamma,
    "epsilon_by_metric": q_epsilon_by_metric,
    "knn_graph": partial(q_knn_graph, False),
    "knn_graph_one_pool": partial(q_knn_graph, True),
    "one_pool_samples": q_one_pool_samples,
    "local_cov": q_local_cov,
    "local_cov_3d": q_local_cov_3d,
    "dist_bhattacharyya_3d": q_dist_bhattacharyya_3d,
}
