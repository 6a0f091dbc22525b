"""X-space search inside pools: k-NN join, range join, anchors.

One blocked scan computes query x chunk similarities with a matrix product per
(pool, chunk block, query block) group and keeps only survivors: the local
top-k under both orderings and every pair inside the distance bound. A
window over the local top-k alone then gives exact ranks with ties broken
on chunk_idx.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dualspace.operators.blocks import DEFAULT_BLOCK, ddl_type, ids, pair_grid, stack_vectors
from dualspace.session import cut_lineage


def cosine_distances(Q: np.ndarray, X: np.ndarray) -> np.ndarray:
    """1 - cosine of every row pair; 1 where a norm is zero."""
    ip = Q @ X.T
    den = np.outer(np.sqrt(np.einsum("ij,ij->i", Q, Q)), np.sqrt(np.einsum("ij,ij->i", X, X)))
    return np.where(den == 0.0, 1.0, 1.0 - ip / np.where(den == 0.0, 1.0, den))


def _scan_kernel(k: int, bound: float | None, distance=cosine_distances):
    def kernel(key, chunks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if len(chunks) == 0 or len(queries) == 0:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in
                                 [("pool_id", object), ("qid", object), ("chunk_idx", object),
                                  ("ip", "float64"), ("dx", "float64"), ("top", "bool")]})
        X = stack_vectors(chunks["x"])
        Q = stack_vectors(queries["q"])
        ip = Q @ X.T
        dx = distance(Q, X)
        kth = min(k, X.shape[0]) - 1
        top = (dx <= np.partition(dx, kth, axis=1)[:, kth:kth + 1]) | (ip >= -np.partition(-ip, kth, axis=1)[:, kth:kth + 1])
        qi, ci = np.nonzero(top if bound is None else top | (dx <= bound))
        return pd.DataFrame({
            "pool_id": [key[0]] * len(qi),
            "qid": ids(queries["qid"])[qi],
            "chunk_idx": ids(chunks["chunk_idx"])[ci],
            "ip": ip[qi, ci],
            "dx": dx[qi, ci],
            "top": top[qi, ci],
        })
    return kernel


def scan(chunks: DataFrame, queries: DataFrame, k: int, bound: float | None,
         chunk_block: int = DEFAULT_BLOCK, query_block: int = 1024, distance=cosine_distances) -> DataFrame:
    """Survivors of the query x chunk product within each pool, with exact ranks.

    chunks(pool_id, chunk_idx, x), queries(pool_id, qid, q) ->
    (pool_id, qid, chunk_idx, ip, dx, rank_ip, rank_dx) holding every pair with
    dx <= bound and at least the top-k of each query under inner product
    (rank_ip) and cosine distance (rank_dx). Ranks are exact up to k; only the rows
    that are among the k best of their block are ranked, so the window sees k rows per
    query and block, the others have null ranks. `bound` None: the top-k only. `distance`: a user's X distance (U2),
    fn(Q, X) -> matrix, in place of the cosine distance.
    """
    c = chunks.select("pool_id", "chunk_idx", "x")
    q = queries.select("pool_id", "qid", "q")
    cg, qg = pair_grid(c, "chunk_idx", q, "qid", chunk_block, query_block)
    keys = ["pool_id", "lb", "rb"]
    schema = (f"pool_id {ddl_type(c, 'pool_id')}, qid {ddl_type(q, 'qid')}, "
              f"chunk_idx {ddl_type(c, 'chunk_idx')}, ip double, dx double, top boolean")
    out = cg.groupBy(*keys).cogroup(qg.groupBy(*keys)).applyInPandas(_scan_kernel(k, bound, distance), schema)
    by_q, none = Window.partitionBy("qid"), F.lit(None).cast("int")
    out = out if bound is None else cut_lineage(out)  # read twice below
    ranked = out.where("top").withColumns({
        "rank_ip": F.row_number().over(by_q.orderBy(F.desc("ip"), "chunk_idx")),
        "rank_dx": F.row_number().over(by_q.orderBy("dx", "chunk_idx"))})
    if bound is None:
        return ranked.drop("top")
    return ranked.unionByName(out.where("not top").withColumns({"rank_ip": none, "rank_dx": none})).drop("top")


def naive_topk(chunks: DataFrame, queries: DataFrame, k: int = 5, scanned: DataFrame | None = None) -> DataFrame:
    """Top-k chunks per query by raw inner product, ties on chunk_idx.

    -> (pool_id, qid, chunk_idx, rank, sim)."""
    s = scanned if scanned is not None else scan(chunks, queries, k, bound=None)
    return s.where(F.col("rank_ip") <= k).select(
        "pool_id", "qid", "chunk_idx", F.col("rank_ip").alias("rank"), F.col("ip").alias("sim"))


def anchors(chunks: DataFrame, queries: DataFrame, tau: float = 0.70, min_anchors: int = 3,
            scanned: DataFrame | None = None) -> DataFrame:
    """R2+R3: every chunk with cosine distance <= tau, plus the min_anchors nearest.

    One predicate over the ranked survivors; no union, no dedupe.
    -> (pool_id, qid, chunk_idx, dx)."""
    s = scanned if scanned is not None else scan(chunks, queries, min_anchors, tau)
    return s.where((F.col("dx") <= tau) | (F.col("rank_dx") <= min_anchors)).select(
        "pool_id", "qid", "chunk_idx", "dx")


def strict_start_set(chunks: DataFrame, queries: DataFrame, tau: float = 0.70,
                     scanned: DataFrame | None = None) -> DataFrame:
    """The strict cutoff start set, d_X(q, x) <= tau. -> (pool_id, qid, chunk_idx, dx)."""
    s = scanned if scanned is not None else scan(chunks, queries, 1, tau)
    return s.where(F.col("dx") <= tau).select("pool_id", "qid", "chunk_idx", "dx")
