"""Z-space metrics (D1-D12) as Column expressions and numpy block kernels.

A metric is a name plus per-pool state:

* `points(pool_id, chunk_idx, v [, cov, logdet])` — the coordinates the metric
  works on (whitened z for Mahalanobis, z otherwise; local Gaussian for
  Bhattacharyya);
* `state(pool_id, s)` — one scalar per pool (max_dot for `dot`, gamma for
  `rbf`, 0 otherwise).

`pair_distance` gives the Column form for joins, `block_distance` the numpy
form used inside blocked kernels. Both compute the same formulas.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from dualspace.functions import vectors as V
from dualspace.operators.blocks import DEFAULT_BLOCK, block_of, n_blocks, pair_grid, pool_counts, sample_per_pool, stack_vectors
from dualspace.session import cut_lineage

METRICS = ["mahalanobis", "euclidean", "cosine", "dot", "bhattacharyya", "rbf"]
# fixed values: the names a metric may be called by
ALIASES = {"dot_product": "dot", "negated_dot": "dot", "kernel": "rbf", "rbf_kernel": "rbf"}
NATIVE = {"mahalanobis", "euclidean", "cosine", "dot", "rbf"}

# Fixed constants of the metric definitions.
INV_COV_RIDGE = 1e-8      # diag(1 / (lambda + 1e-8))
LOCAL_COV_RIDGE = 1e-6    # local covariance + 1e-6 * I
RBF_SAMPLE = 200          # median heuristic sample size
RBF_SEED = 0
RBF_FLOOR = 1e-8
BHAT_K = 10               # neighbours per local Gaussian


def canonical(name):
    """The metric's own name; a callable (a user's distance, U2) stays what it is:
    fn(A, B), rows against rows, gives the matrix of their distances."""
    if callable(name):
        return name
    n = name.lower()
    n = ALIASES.get(n, n)
    if n not in METRICS:
        raise ValueError(f"unknown Z metric: {name}")
    return n


@dataclass
class MetricSpace:
    metric: str
    points: DataFrame   # pool_id, chunk_idx, v [, cov, logdet]
    state: DataFrame    # pool_id, s
    dim: int | None = None


# --------------------------------------------------------------------------- state


def max_dot(z: DataFrame) -> DataFrame:
    """D4 offset: max over all pairs of z_i.z_j equals max_i |z_i|^2 (Cauchy-Schwarz),
    so one O(N) aggregate replaces the N^2 pass."""
    return z.groupBy("pool_id").agg(F.max(V.sq_norm("z")).alias("s"))


def _upper(D: np.ndarray) -> np.ndarray:
    """The entries of a square matrix above its diagonal: the pairs i < j."""
    return D[np.triu_indices(len(D), 1)]


def rbf_gamma(z: DataFrame, sample: int = RBF_SAMPLE, seed=RBF_SEED) -> DataFrame:
    """D7 median heuristic: gamma = 1 / max(median positive |zi - zj|^2, 1e-8); median 1.0 if none.
    A pool's group holds its sample, at most `sample` rows."""
    s = sample_per_pool(z.select("pool_id", "chunk_idx", "z"), "chunk_idx", sample, seed)

    def gamma(key, g: pd.DataFrame) -> pd.DataFrame:
        Z = stack_vectors(g["z"])
        sq = _upper(sq_dists(Z, Z))
        med = float(np.median(sq[sq > 0])) if (sq > 0).any() else 1.0
        return pd.DataFrame({"pool_id": [key[0]], "s": [1.0 / max(med, RBF_FLOOR)]})
    return s.groupBy("pool_id").applyInPandas(gamma, f"pool_id {s.schema['pool_id'].dataType.simpleString()}, s double")


KNN_PIVOTS = 8
KNN_CELL = 16_384  # points of a side of a cell
KNN_SEED = 13


def ball_blocks(z: DataFrame, block: int, pivots: int = KNN_PIVOTS, seed=KNN_SEED) -> DataFrame:
    """(pool_id, chunk_idx, z, pd, b): blocks of at most about `block` points around one pivot each; pd are the
    Euclidean distances to all pivots of the pool. A pool of at most `block` points is one block."""
    pts = z.select("pool_id", "chunk_idx", "z")
    chosen = sample_per_pool(pts, "chunk_idx", pivots, seed).groupBy("pool_id").agg(
        F.sort_array(F.collect_list(F.struct("chunk_idx", "z"))).alias("chosen"))
    rows = pts.join(chosen, "pool_id").join(pool_counts(pts, "n"), "pool_id").sortWithinPartitions("pool_id")
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("pool_id", "chunk_idx")}

    def run(batches):
        for pdf in batches:
            for _, g in pdf.groupby("pool_id", sort=False):
                P = np.array([c["z"] for c in g["chosen"].iloc[0]], dtype=np.float64)
                d = np.sqrt(sq_dists(stack_vectors(g["z"]), P))
                large = int(g["n"].iloc[0]) > block
                yield pd.DataFrame({"pool_id": g["pool_id"], "chunk_idx": g["chunk_idx"], "z": g["z"], "pd": list(d),
                                    "cluster": d.argmin(axis=1).astype(np.int32) if large else np.int32(0)})
    near = cut_lineage(rows.mapInPandas(run, f"pool_id {kind['pool_id']}, chunk_idx {kind['chunk_idx']}, z array<double>, pd array<double>, cluster int"))
    parts = near.groupBy("pool_id", "cluster").agg(F.count(F.lit(1)).alias("m")).select("pool_id", "cluster", n_blocks("m", block).alias("parts"))
    return near.join(parts, ["pool_id", "cluster"]).withColumn("b", F.concat_ws("-", "cluster", block_of("chunk_idx", "parts"))).drop("cluster", "parts")


def _near_pairs(A: np.ndarray, B: np.ndarray, most: int, bound: np.ndarray | None, cells: int = 4_000_000):
    """(row of A, row of B, d2) of a few pairs more than those within each row's bound (None: than its `most` nearest). A product in
    single precision, with a margin over its rounding, says which pairs these may be; their distances come from exact differences."""
    na, nb = (np.einsum("ij,ij->i", X, X) for X in (A, B))
    far = np.sqrt(nb.max(initial=0.0))
    plain = not (np.isfinite(na).all() and np.isfinite(far) and (np.sqrt(na) + far).max(initial=0.0) < 1e15)
    a32, b32, nb32 = A.astype(np.float32), B.astype(np.float32), nb.astype(np.float32)
    margin = 2.4e-7 * (A.shape[1] + 16) * (np.sqrt(na) + far) ** 2
    out, step = [], max(1, cells // max(len(B), 1))
    for at in range(0, len(A), step):
        part = slice(at, at + step)
        if plain:
            near, slack = sq_dists(A[part], B), np.zeros(len(A[part]))
        else:
            near, slack = a32[part] @ b32.T, margin[part]
            near *= np.float32(-2)
            near += nb32
            near += na[part, None].astype(np.float32)
        if bound is not None:
            limit = bound[part] + slack
        else:
            limit = np.partition(near, most - 1, axis=1)[:, most - 1] + 2 * slack if near.shape[1] >= most else np.full(len(near), np.inf)
        ii, jj = np.nonzero(near <= limit[:, None])
        for n in range(0, len(ii), max(1, cells // max(A.shape[1], 1))):
            i, j = (x[n:n + max(1, cells // max(A.shape[1], 1))] for x in (ii, jj))
            diff = A[at + i] - B[j]
            out.append((at + i, j, np.einsum("ij,ij->i", diff, diff)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def _first(rows: int, most: int, ii, jj, d2, bound: np.ndarray | None = None):
    """Of pairs (row, rank of the other id, d2) each row's `most` first by (d2, rank), none beyond its bound; and the rows'
    `most`-th distances, infinite where there are fewer pairs."""
    inside = d2 <= (np.inf if bound is None else bound[ii])
    ii, jj, d2 = ii[inside], jj[inside], d2[inside]
    order = np.lexsort((jj, d2, ii))
    ii, jj, d2 = ii[order], jj[order], d2[order]
    n = np.bincount(ii, minlength=rows)
    starts = np.cumsum(n) - n
    kth = np.full(rows, np.inf)
    full = n >= most
    kth[full] = d2[starts[full] + most - 1]
    keep = np.arange(len(ii)) - starts[ii] < most
    return ii[keep], jj[keep], d2[keep], kth


def _k_nearest(left: pd.DataFrame, right: pd.DataFrame, most: int, bound: np.ndarray | None = None, chunk: int = DEFAULT_BLOCK):
    """Rows (i, j, d2) with each left point's `most` nearest right points (ties to the smaller id), none beyond its bound. With bounds,
    `chunk` right points at a time: left points whose distances to the pivots say that none of them is near enough are left
    out, and what a chunk has brings the bounds down for the next."""
    A, B, ids = stack_vectors(left["z"]), stack_vectors(right["z"]), right["chunk_idx"].to_numpy()
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[by_id] = np.arange(len(ids))
    if bound is None:
        ii, jj, d2 = _near_pairs(A, B, most, None)
        ii, jj, d2, kth = _first(len(A), most, ii, rank[jj], d2)
    else:
        own, other = stack_vectors(left["pd"]), stack_vectors(right["pd"])
        ii, jj, d2, kth = np.empty(0, int), np.empty(0, int), np.empty(0), np.array(bound, dtype=np.float64)
        for at in range(0, len(B), chunk):
            lo, hi = other[at:at + chunk].min(axis=0), other[at:at + chunk].max(axis=0)
            gap = np.maximum(lo - own, own - hi).max(axis=1)
            rows = np.flatnonzero(~(gap > np.sqrt(kth) * (1 + 1e-9) + 1e-9))
            if not len(rows):
                continue
            i, j, d = _near_pairs(A[rows], B[at:at + chunk], most, kth[rows])
            ii, jj, d2, new = _first(len(A), most, np.append(ii, rows[i]), np.append(jj, rank[at + j]), np.append(d2, d), kth)
            kth = np.minimum(kth, new)
    return pd.DataFrame({"i": left["chunk_idx"].to_numpy()[ii], "j": ids[by_id[jj]], "d2": d2, "kth": kth[ii]})


def knn_cells(own: DataFrame, points: DataFrame) -> DataFrame:
    """(pool_id, b, other): the pairs of different blocks that may hold a neighbour. `own` has each point's k-th
    distance inside its block, `points` the blocks; a block's ranges of distances to the pivots say how near another can come."""
    far = own.groupBy("pool_id", "b").agg(F.sqrt(F.max("kth")).alias("reach"))
    kind = f"pool_id {points.schema['pool_id'].dataType.simpleString()}, b string, lo array<double>, hi array<double>"

    def ranges(key, g: pd.DataFrame) -> pd.DataFrame:
        d = stack_vectors(g["pd"])
        return pd.DataFrame({"pool_id": [key[0]], "b": [key[1]], "lo": [d.min(axis=0)], "hi": [d.max(axis=0)]})
    meta = cut_lineage(points.select("pool_id", "b", "pd").groupBy("pool_id", "b").applyInPandas(ranges, kind).join(far, ["pool_id", "b"]))
    a = meta.select("pool_id", "b", "reach", F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"))
    b = meta.select("pool_id", F.col("b").alias("other"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"))
    gap = F.array_max(F.concat(F.zip_with("lo_i", "hi_j", lambda x, y: x - y), F.zip_with("lo_j", "hi_i", lambda x, y: x - y)))
    return a.join(b, "pool_id").where((F.col("b") != F.col("other")) & (gap <= F.col("reach") * (1 + 1e-9) + 1e-9)).select("pool_id", "b", "other")


def knn_graph(z: DataFrame, k: int = BHAT_K, block: int = DEFAULT_BLOCK) -> DataFrame:
    """The k nearest points of every point by squared Euclidean distance, self
    included, k clamped to max(2, min(k, N-1)); ties broken on chunk_idx.

    Points lie in ball blocks. The first round takes the neighbours inside the own block and with them a bound, the
    k-th distance so far; the second visits only cells of blocks of which some can come nearer than the farthest such bound of
    a block (triangle inequality over the pivots) and passes on at most k pairs per point and cell, within the point's own bound. A window over the survivors gives
    the exact ranks; every distance is the same exact formula. -> (pool_id, i, j, rank, d2)."""
    most = max(2, k)  # the clamp below asks for two neighbours at least
    pts = cut_lineage(ball_blocks(z, block))
    pool, chunk = (pts.schema[c].dataType.simpleString() for c in ("pool_id", "chunk_idx"))
    found = f"pool_id {pool}, b string, i {chunk}, j {chunk}, d2 double, kth double"

    def inside(key, g: pd.DataFrame) -> pd.DataFrame:
        out = _k_nearest(g, g, most)
        out.insert(0, "b", key[1])
        out.insert(0, "pool_id", key[0])
        return out
    own = cut_lineage(pts.select("pool_id", "b", "chunk_idx", "z").groupBy("pool_id", "b").applyInPandas(inside, found))
    rows = own.select("pool_id", "i", "j", "d2")
    several = cut_lineage(pool_counts(pts, "n").where(F.col("n") > block).select("pool_id"))  # pools of more than one block
    pairs = None if several.isEmpty() else cut_lineage(knn_cells(own.join(several, "pool_id", "left_semi"), pts.join(several, "pool_id", "left_semi")))
    if pairs is not None and not pairs.isEmpty():
        # blocks meet in cells of several, which one shuffle carries: a cell has at most about KNN_CELL points of each side
        last = Window.partitionBy("pool_id")
        size = F.greatest(F.lit(block), F.least(F.lit(max(block, KNN_CELL)), F.ceil(F.sum("m").over(last) / 8)))
        parts = pts.groupBy("pool_id", "b").agg(F.count(F.lit(1)).alias("m")).withColumn(
            "cell", F.floor((F.sum("m").over(last.orderBy("b")) - F.col("m")) / size).cast("int"))
        parts = cut_lineage(parts.select("pool_id", "b", "cell"))
        meet = cut_lineage(pairs.join(parts.withColumnRenamed("cell", "ci"), ["pool_id", "b"]).join(
            parts.select("pool_id", F.col("b").alias("other"), F.col("cell").alias("cj")), ["pool_id", "other"]).select("pool_id", "ci", "cj").distinct())
        body = pts.select("pool_id", "b", "chunk_idx", "z", "pd").join(parts, ["pool_id", "b"])
        bounds = own.groupBy("pool_id", F.col("i").alias("chunk_idx")).agg(F.max("kth").alias("kth"))
        left = body.join(bounds, ["pool_id", "chunk_idx"]).withColumnRenamed("cell", "ci").join(meet, ["pool_id", "ci"])
        right = body.withColumnRenamed("cell", "cj").join(meet, ["pool_id", "cj"])
        right = right.select(*[F.col(c).alias(c) for c in right.columns])  # own lineage: both sides descend from `pts`
        spread = [max(1, min(10_000, meet.count())), "pool_id", "ci", "cj"]  # a number, which AQE keeps

        def across(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({c: pd.Series(dtype=object) for c in ("i", "j", "d2")})]
            if len(a) and len(b):
                b = b.sort_values("b")
                for name, g in (a.groupby("b", sort=False) if key[1] == key[2] else [(None, a)]):
                    others = b if name is None else b[b["b"] != name]  # a block has met itself
                    if len(others):
                        out.append(_k_nearest(g, others, most, g["kth"].to_numpy(float)))
            out = pd.concat(out[1:] or out)
            out.insert(0, "pool_id", key[0])
            return out[["pool_id", "i", "j", "d2"]]
        keys = ["pool_id", "ci", "cj"]
        rows = rows.union(left.repartition(*spread).groupBy(*keys).cogroup(right.repartition(*spread).groupBy(*keys)).applyInPandas(
            across, f"pool_id {pool}, i {chunk}, j {chunk}, d2 double"))
    sizes = pool_counts(pts, "n").select(
        "pool_id", F.greatest(F.lit(2), F.least(F.lit(k), F.col("n") - 1)).alias("k_eff"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("pool_id", "i").orderBy("d2", "j")))
    return ranked.join(sizes, "pool_id").where(F.col("rank") <= F.col("k_eff")).select(
        "pool_id", "i", "j", "rank", "d2")


def local_covariance(z: DataFrame, lam: DataFrame, dim: int | None = None, k: int = BHAT_K) -> DataFrame:
    """Covariance (n-1) of each point's k-NN plus 1e-6 I, and its log-determinant.

    Each point folds its k <= 10 neighbour vectors (a bounded collect) and an
    Arrow UDF computes the covariance for whatever Z dimension its pool has
    (d_eff varies with pool size). A single-neighbour point falls back to
    diag(lambda). -> (pool_id, chunk_idx, cov ARRAY<DOUBLE> row-major, logdet)."""
    g = knn_graph(z, k)
    nb = g.join(z.select("pool_id", F.col("chunk_idx").alias("j"), "z"), ["pool_id", "j"])
    folded = nb.groupBy("pool_id", F.col("i").alias("chunk_idx")).agg(F.collect_list("z").alias("nbrs"))
    out = folded.join(lam, "pool_id").select("pool_id", "chunk_idx", local_cov_udf("nbrs", "lam").alias("cov"))
    return out.withColumn("logdet", logdet_udf(F.col("cov")))


def _alike(shapes: list) -> list[tuple]:
    """(shape, positions) of rows that stack: pools differ in Z dimension, so a batch may too."""
    groups: dict = {}
    for i, shape in enumerate(shapes):
        groups.setdefault(shape, []).append(i)
    return list(groups.items())


@F.pandas_udf(ArrayType(DoubleType()))
def local_cov_udf(nbrs: pd.Series, lam: pd.Series) -> pd.Series:
    out: list = [None] * len(nbrs)
    rows = [np.stack([np.asarray(v, dtype=np.float64) for v in nb]) for nb in nbrs]
    for (k, d), at in _alike([r.shape for r in rows]):
        A = np.stack([rows[i] for i in at])
        if k > 1:
            A = A - A.mean(axis=1, keepdims=True)
            C = np.einsum("mki,mkj->mij", A, A) / (k - 1)
        else:
            C = np.stack([np.diag(np.asarray(lam.iloc[i], dtype=np.float64)[:d]) for i in at])
        C = C + LOCAL_COV_RIDGE * np.eye(d)
        for n, i in enumerate(at):
            out[i] = C[n].ravel()
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def logdet_udf(cov: pd.Series) -> pd.Series:
    out = np.empty(len(cov))
    for n, at in _alike([len(c) for c in cov]):
        d = int(round(np.sqrt(n)))
        out[at] = np.linalg.slogdet(stack_vectors(cov.iloc[at]).reshape(-1, d, d))[1]
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def bhattacharyya_udf(zi: pd.Series, zj: pd.Series, ci: pd.Series, cj: pd.Series,
                      li: pd.Series, lj: pd.Series) -> pd.Series:
    out = np.empty(len(zi))
    for d, at in _alike([len(z) for z in zi]):
        diff = stack_vectors(zi.iloc[at]) - stack_vectors(zj.iloc[at])
        out[at] = _bhattacharyya(diff, stack_vectors(ci.iloc[at]).reshape(-1, d, d), stack_vectors(cj.iloc[at]).reshape(-1, d, d),
                                 li.iloc[at].to_numpy(float), lj.iloc[at].to_numpy(float))
    return pd.Series(out)


def fallback_bhattacharyya(zi, zj, lam) -> Column:
    """D5 for points without a local Gaussian: both take diag(lambda) + ridge, so only
    the quadratic term is left."""
    diff = V.subtract(zi, zj)
    terms = F.zip_with(diff, lam, lambda x, v: x * x / (v + F.lit(LOCAL_COV_RIDGE)))
    return F.lit(0.125) * F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def _bhattacharyya(diff: np.ndarray, Ci: np.ndarray, Cj: np.ndarray, li: np.ndarray, lj: np.ndarray) -> np.ndarray:
    """Vectorised D5 over aligned rows: 1/8 diff' S^-1 diff + 1/2 (ln|S| - (ln|Ci| + ln|Cj|)/2),
    S = (Ci + Cj)/2, clipped at 0."""
    S = 0.5 * (Ci + Cj)
    try:
        sol = np.linalg.solve(S, diff[..., None])[..., 0]
    except np.linalg.LinAlgError:
        sol = np.einsum("nij,nj->ni", np.linalg.pinv(S), diff)
    mahal = 0.125 * np.einsum("ni,ni->n", diff, sol)
    lds = np.linalg.slogdet(S)[1]
    return np.maximum(mahal + 0.5 * (lds - 0.5 * (li + lj)), 0.0)


def sq_dists(A: np.ndarray, B: np.ndarray, cells: int = 4_000_000) -> np.ndarray:
    """Squared Euclidean distances of two row blocks, always from exact differences;
    `cells` bounds the temporary, by rows of A at a time."""
    out = np.empty((A.shape[0], B.shape[0]))
    step = max(1, cells // max(B.size, 1))
    for at in range(0, A.shape[0], step):
        diff = A[at:at + step, None, :] - B[None, :, :]
        out[at:at + step] = np.einsum("ijk,ijk->ij", diff, diff)
    return out


# --------------------------------------------------------------------------- spaces


def build_space(metric, z: DataFrame, lam: DataFrame, dim: int | None = None) -> MetricSpace:
    """Per-pool state for `metric` over z(pool_id, chunk_idx, z) and lam(pool_id, lam)."""
    m = canonical(metric)
    zero_state = z.select("pool_id").distinct().withColumn("s", F.lit(0.0))
    if callable(m):
        return MetricSpace(m, z.select("pool_id", "chunk_idx", F.col("z").alias("v")), zero_state, dim)
    if m == "mahalanobis":
        pts = z.join(lam, "pool_id").select("pool_id", "chunk_idx", V.whiten("z", "lam", INV_COV_RIDGE).alias("v"))
        return MetricSpace(m, pts, zero_state, dim)
    base = z.select("pool_id", "chunk_idx", F.col("z").alias("v"))
    if m in ("euclidean", "cosine"):
        return MetricSpace(m, base, zero_state, dim)
    if m == "dot":
        return MetricSpace(m, base, max_dot(z), dim)
    if m == "rbf":
        return MetricSpace(m, base, rbf_gamma(z), dim)
    if dim is None:
        raise ValueError("bhattacharyya needs the Z dimension")
    lc = local_covariance(z, lam, dim)
    pts = base.join(lc, ["pool_id", "chunk_idx"])
    return MetricSpace(m, pts, zero_state, dim)


def _callable_udf(fn):
    @F.pandas_udf(DoubleType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(fn(np.asarray(x, dtype=np.float64)[None], np.asarray(y, dtype=np.float64)[None])[0, 0])
                          for x, y in zip(a, b)], dtype="float64")
    return distance


def pair_distance(metric, vi="v_i", vj="v_j", s="s", extra: tuple | None = None) -> Column:
    """Column distance between two points of a pair row."""
    m = canonical(metric)
    if callable(m):
        return _callable_udf(m)(F.col(vi), F.col(vj))
    if m in ("euclidean", "mahalanobis"):
        return V.euclidean(vi, vj)
    if m == "cosine":
        return V.cosine_distance(vi, vj)
    if m == "dot":
        return F.col(s) - V.dot(vi, vj)
    if m == "rbf":
        val = F.lit(2.0) - F.lit(2.0) * F.exp(-F.col(s) * V.sq_euclidean(vi, vj))
        return F.sqrt(F.greatest(val, F.lit(0.0)))
    ci, cj, li, lj = extra or ("cov_i", "cov_j", "logdet_i", "logdet_j")
    return bhattacharyya_udf(F.col(vi), F.col(vj), F.col(ci), F.col(cj), F.col(li), F.col(lj))


def point_columns(metric) -> list[str]:
    return ["v", "cov", "logdet"] if canonical(metric) == "bhattacharyya" else ["v"]


def packed_points(points: DataFrame, metric) -> DataFrame:
    """(pool_id, chunk_idx, flat): all coordinates of a point in one array."""
    cols = point_columns(metric)
    flat = F.col("v") if len(cols) == 1 else F.concat("v", "cov", F.array("logdet"))
    return points.select("pool_id", "chunk_idx", *cols).select("pool_id", "chunk_idx", flat.alias("flat"))


def unpacked_points(flat, metric, n: int):
    """(v, cov, logdet) of `n` points laid end to end as `packed_points` packs them."""
    X = np.asarray(flat, dtype=np.float64).reshape(n, -1)
    if canonical(metric) != "bhattacharyya":
        return X, None, None
    d = int((-1 + np.sqrt(1 + 4 * (X.shape[1] - 1))) / 2 + 0.5)
    return X[:, :d], X[:, d:-1].reshape(n, d, d), X[:, -1]


def block_distance(metric, Vi: np.ndarray, Vj: np.ndarray, s: float,
                   Ci=None, Cj=None, Li=None, Lj=None) -> np.ndarray:
    """Numpy twin of `pair_distance` for a block of rows x a block of columns."""
    m = canonical(metric)
    if callable(m):
        return np.asarray(m(Vi, Vj), dtype=np.float64)
    if m in ("euclidean", "mahalanobis", "rbf"):
        d2 = sq_dists(Vi, Vj)
        if m == "rbf":
            return np.sqrt(np.maximum(2.0 - 2.0 * np.exp(-s * d2), 0.0))
        return np.sqrt(d2)
    if m == "cosine":
        ni, nj = np.sqrt((Vi * Vi).sum(1)), np.sqrt((Vj * Vj).sum(1))
        den = np.outer(ni, nj)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(den == 0, 1.0, 1.0 - (Vi @ Vj.T) / np.where(den == 0, 1.0, den))
    if m == "dot":
        return s - Vi @ Vj.T
    out = np.empty((Vi.shape[0], Vj.shape[0]))
    n, d = Vj.shape
    step = max(1, 500_000 // max(n * d * d, 1))
    for at in range(0, Vi.shape[0], step):
        m = len(Vi[at:at + step])
        diff = (Vj[None] - Vi[at:at + step, None]).reshape(-1, d)
        out[at:at + step] = _bhattacharyya(
            diff, np.repeat(Ci[at:at + step], n, axis=0), np.tile(Cj, (m, 1, 1)),
            np.repeat(Li[at:at + step], n), np.tile(Lj, m)).reshape(m, n)
    return out


# --------------------------------------------------------------------------- epsilon


def calibrate_epsilon(space: MetricSpace, quantile: float = 0.10, sample: int = 50, seed=42) -> DataFrame:
    """epsilon = linear-interpolated `quantile` of pair distances over a seeded
    sample of at most `sample` points per pool (what a group holds); 1.0 when a pool has no pair.
    -> (pool_id, epsilon)."""
    cols, metric = point_columns(space.metric), space.metric
    s = sample_per_pool(space.points.select("pool_id", "chunk_idx", *cols), "chunk_idx", sample, seed).join(
        space.state.select("pool_id", "s"), "pool_id")

    def epsilon(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("chunk_idx")
        V = stack_vectors(g["v"])
        C, L = ((stack_vectors(g["cov"]).reshape(len(V), V.shape[1], -1), g["logdet"].to_numpy(float))
                if metric == "bhattacharyya" else (None, None))
        d = _upper(block_distance(metric, V, V, float(g["s"].iloc[0]), C, C, L, L))
        return pd.DataFrame({"pool_id": [key[0]], "epsilon": [float(np.quantile(d, quantile)) if len(d) else 1.0]})
    return s.groupBy("pool_id").applyInPandas(epsilon, f"pool_id {s.schema['pool_id'].dataType.simpleString()}, epsilon double")


def reference_distances(space: MetricSpace, references: DataFrame, block: int = DEFAULT_BLOCK,
                        reference_block: int = 1024) -> DataFrame:
    """D1-D6 from the stated reference points (pool_id, chunk_idx) to all other points
    of their pools, on a grid of blocks. -> (pool_id, i, j, d)."""
    cols = point_columns(space.metric)
    pts = space.points.select("pool_id", "chunk_idx", *cols).join(space.state.select("pool_id", "s"), "pool_id")
    left = pts.join(references.select("pool_id", "chunk_idx"), ["pool_id", "chunk_idx"], "left_semi")
    twin = pts.select(*[F.col(c).alias(c) for c in pts.columns])
    lg, rg = pair_grid(left, "chunk_idx", twin, "chunk_idx", reference_block, block)
    metric = space.metric

    def kernel(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({"pool_id": pd.Series(dtype=object), "i": pd.Series(dtype=object),
                                 "j": pd.Series(dtype=object), "d": pd.Series(dtype="float64")})
        part = lambda p: ((stack_vectors(p["cov"]).reshape(len(p), -1, len(p["v"].iloc[0])), p["logdet"].to_numpy(float))
                          if metric == "bhattacharyya" else (None, None))
        (ca, la), (cb, lb) = part(a), part(b)
        d = block_distance(metric, stack_vectors(a["v"]), stack_vectors(b["v"]), float(a["s"].iloc[0]), ca, cb, la, lb)
        ii, jj = np.nonzero(a["chunk_idx"].to_numpy()[:, None] != b["chunk_idx"].to_numpy()[None, :])
        return pd.DataFrame({"pool_id": [key[0]] * len(ii), "i": a["chunk_idx"].to_numpy()[ii],
                             "j": b["chunk_idx"].to_numpy()[jj], "d": d[ii, jj]})
    keys = ["pool_id", "lb", "rb"]
    kind = {c: pts.schema[c].dataType.simpleString() for c in ("pool_id", "chunk_idx")}
    return lg.groupBy(*keys).cogroup(rg.groupBy(*keys)).applyInPandas(
        kernel, f"pool_id {kind['pool_id']}, i {kind['chunk_idx']}, j {kind['chunk_idx']}, d double")


__all__ = [
    "METRICS", "MetricSpace", "build_space", "pair_distance", "block_distance", "calibrate_epsilon",
    "reference_distances", "knn_graph", "local_covariance", "rbf_gamma", "max_dot", "canonical", "calibrate_epsilons",
]


def calibrate_epsilons(z: DataFrame, lam: DataFrame, metrics: list[str], quantile: float = 0.10,
                       sample: int = 50, seed=42) -> DataFrame:
    """D11 for several native metrics at once (R15): one seeded sample per pool, every
    metric evaluated on the same pairs. -> (pool_id, metric, epsilon)."""
    ms = [canonical(m) for m in metrics]
    if any(m not in NATIVE for m in ms):
        raise ValueError("calibrate_epsilons covers the native metrics; use calibrate_epsilon for bhattacharyya")
    s = sample_per_pool(z.select("pool_id", "chunk_idx", "z"), "chunk_idx", sample, seed).join(lam, "pool_id")
    if "dot" in ms:
        s = s.join(max_dot(z).withColumnRenamed("s", "max_dot"), "pool_id")
    if "rbf" in ms:
        s = s.join(rbf_gamma(z).withColumnRenamed("s", "gamma"), "pool_id")

    def epsilons(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("chunk_idx")
        Z = stack_vectors(g["z"])
        W = Z / np.sqrt(np.asarray(g["lam"].iloc[0], dtype=np.float64) + INV_COV_RIDGE)
        out = []
        for m in ms:
            V = W if m == "mahalanobis" else Z
            state = float(g["max_dot"].iloc[0]) if m == "dot" else float(g["gamma"].iloc[0]) if m == "rbf" else 0.0
            d = _upper(block_distance(m, V, V, state))
            out.append((key[0], m, float(np.quantile(d, quantile)) if len(d) else 1.0))
        return pd.DataFrame(out, columns=["pool_id", "metric", "epsilon"])
    return s.groupBy("pool_id").applyInPandas(
        epsilons, f"pool_id {s.schema['pool_id'].dataType.simpleString()}, metric string, epsilon double")
