"""Registered traversal plans: decay (R4-R6, W4, W5) and random walk."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dualspace.operators import decay, pca
from dualspace.operators import metrics as M
from dualspace.plans.common import GAMMA_ALT, GAMMA_MAIN, TAU_ALT, TAU_MAIN
from dualspace.plans.metric_plans import EPS_SAMPLE, EPS_SEED, Z_DIMS, Z_DIMS_BHAT
from dualspace.session import cut_lineage
from dualspace.sources.fixtures import chunk_vectors, query_vectors, z_standin

MAX_HOPS = 2
ONE_POOL_BLOCK, ONE_POOL_QUERIES = 256, 32  # so that the one pool is cut into several blocks


def _decay(spark: SparkSession, sf_dir: str, metric: str, tau: float, gamma: float,
           start: str = "anchors", z: tuple[DataFrame, DataFrame] | None = None, one_pool: bool = False, **blocks) -> DataFrame:
    chunks, queries = chunk_vectors(spark, sf_dir), query_vectors(spark, sf_dir)
    if one_pool:  # the whole table as one pool
        chunks, queries = (df.withColumn("pool_id", F.lit(0).cast("bigint")) for df in (chunks, queries))
    dims = Z_DIMS_BHAT if metric == "bhattacharyya" else Z_DIMS
    z, lam = z_standin(chunks, dims) if z is None else z
    space = M.build_space(metric, z, lam, dims)
    eps = M.calibrate_epsilon(space, 0.10, EPS_SAMPLE, EPS_SEED)
    return decay.decay_traversal(chunks, queries, space, eps, tau, gamma, MAX_HOPS, 3, start, **blocks)


def q_decay_hops(metric: str, tau: float, gamma: float, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decay(spark, sf_dir, metric, tau, gamma)


def _pca_space(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """X -> PCA -> Z with every component, so that Z keeps the distances of X."""
    z, lam, _ = pca.structural_space(chunk_vectors(spark, sf_dir), Z_DIMS)
    return cut_lineage(z), cut_lineage(lam)


def q_decay_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: embeddings, fitted PCA, epsilon, hops."""
    return _decay(spark, sf_dir, "euclidean", TAU_MAIN, GAMMA_MAIN, z=_pca_space(spark, sf_dir))


def q_decay_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decay(spark, sf_dir, "euclidean", TAU_MAIN, GAMMA_MAIN, start="strict")


def q_decay_one_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as one pool, in blocks around pivots."""
    return _decay(spark, sf_dir, "mahalanobis", TAU_MAIN, GAMMA_MAIN, one_pool=True, block=ONE_POOL_BLOCK, query_block=ONE_POOL_QUERIES)


def q_decay_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decay.cap_layers(_decay(spark, sf_dir, "mahalanobis", TAU_MAIN, GAMMA_MAIN), 5, 10)


QUERIES = {
    "decay_hops": partial(q_decay_hops, "mahalanobis", TAU_MAIN, GAMMA_MAIN),
    "decay_hops_alt": partial(q_decay_hops, "euclidean", TAU_ALT, GAMMA_ALT),
    "decay_hops_cosine": partial(q_decay_hops, "cosine", TAU_MAIN, GAMMA_MAIN),
    "decay_hops_dot": partial(q_decay_hops, "dot", TAU_MAIN, GAMMA_MAIN),
    "decay_hops_rbf": partial(q_decay_hops, "rbf", TAU_MAIN, GAMMA_MAIN),
    "decay_hops_bhattacharyya_2d": partial(q_decay_hops, "bhattacharyya", TAU_MAIN, GAMMA_MAIN),
    "decay_pca": q_decay_pca,
    "decay_strict": q_decay_strict,
    "decay_one_pool": q_decay_one_pool,
    "decay_capped": q_decay_capped,
}


# --------------------------------------------------------------------------- walk
def _walk_input(spark: SparkSession, sf_dir: str, metric: str, tau: float, start: str,
                z: tuple[DataFrame, DataFrame] | None = None, one_pool: bool = False):
    from dualspace.operators import search
    chunks, queries = chunk_vectors(spark, sf_dir), query_vectors(spark, sf_dir)
    if one_pool:  # the whole table as one pool
        chunks, queries = (df.withColumn("pool_id", F.lit(0).cast("bigint")) for df in (chunks, queries))
    z, lam = z_standin(chunks, Z_DIMS) if z is None else z
    space = M.build_space(metric, z, lam, Z_DIMS)
    if start == "anchors":
        seeds = search.anchors(chunks, queries, tau, 3)
    else:
        seeds = search.strict_start_set(chunks, queries, tau)
    seeds = cut_lineage(seeds.select("pool_id", "qid", "chunk_idx"))
    return space.points, space.state, metric, seeds, queries.select("pool_id", "qid")


def _walk(*args, **more) -> DataFrame:
    from dualspace.operators import walk
    return walk.random_walk(*_walk_input(*args, **more))


def q_ppr_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dualspace.plans.common import rounded
    mass = _walk(spark, sf_dir, "mahalanobis", TAU_MAIN, "anchors")
    return rounded(mass, "mass")


def q_ppr_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dualspace.plans.common import rounded
    mass = _walk(spark, sf_dir, "euclidean", TAU_MAIN, "anchors", _pca_space(spark, sf_dir))
    return rounded(mass, "mass")


def q_ppr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dualspace.operators import walk
    given = _walk_input(spark, sf_dir, "mahalanobis", TAU_MAIN, "anchors")
    return walk.roles_of_top(walk.walk_top_k(*given, k=5), given[3], 5)


def q_ppr_mass_one_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as one pool, in blocks."""
    from dualspace.operators import walk
    from dualspace.plans.common import rounded
    given = _walk_input(spark, sf_dir, "euclidean", TAU_MAIN, "anchors", one_pool=True)
    return rounded(walk.random_walk(*given, block=ONE_POOL_BLOCK, query_block=ONE_POOL_QUERIES), "mass")


def q_walk_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dualspace.plans.common import rounded
    mass = _walk(spark, sf_dir, "euclidean", TAU_ALT, "strict")
    return rounded(mass, "mass")


QUERIES.update({
    "ppr_mass": q_ppr_mass,
    "ppr_mass_one_pool": q_ppr_mass_one_pool,
    "ppr_pca": q_ppr_pca,
    "ppr_topk": q_ppr_topk,
    "walk_strict": q_walk_strict,
})
