"""Exact top-k by inner product: columnar branch and bound.

Vectors are quantised to integers. Query and candidate blocks meet on a grid, so a
task holds one block of each. There the candidates lie dimension by dimension. Each
query takes the dimensions in its own order, those of its heaviest components first, and
adds up the scores of its candidates one block of dimensions at a time. What the
dimensions to come can still add is at most the product of the remaining norms
(Cauchy-Schwarz); after every block the candidates whose bound stays below the query's
floor leave and the rest are compacted. The floor, the k-th best score known so far, comes
from the candidates that lead after each block, whose scores are completed at once.
Bounds are doubles with a stated margin; the scores of the candidates that are left are
whole-number products, so one path serves components of any size.

The cells of one candidate block run first. The k-th best score that a query finds there
is its floor in all other cells, which as a rule then drop most candidates after a few
blocks of dimensions. Only each cell's k best per query leave the task; a window ranks these.

Scale: work is the number of queries times that of candidates, spread over bounded cells;
shuffled are the candidates once per query block, the queries once per candidate
block, and k rows per query and cell. Equal rows travel and are scored once.

Defined cases: vectors that are null or hold a null or non-finite component, and rows with a
null id, take no part; a query row is not its own candidate, every other row is, rows of the same
id included; each query row has its own ranking, so an id on n query rows gives n rankings;
equal rows fill as many ranks as there are rows; vectors of different lengths are not
compared; an empty vector scores 0 with other empty ones; fewer than k candidates give
fewer rows; an empty table gives none; other columns are ignored. A component or a score in
a result that a long cannot hold raises an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dualspace.llm.common import written
from dualspace.session import ship_package

K = 5
SCALE = 256
CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 4096
DIMS = 8
TASKS = 10_000  # most tasks of a grid; beyond it a task takes several cells, one after another


def best_pairs(q, qrow, c, crow, cid, copies, k: int, floors=None, summed: list | None = None):
    """Of integer matrices: positions (query, candidate) and scores that hold each query's k best
    rows (ties to the smaller candidate id), and no more than k per query. A candidate stands for
    `copies` equal rows. `floors`: scores below which a query needs no candidate. To `summed` goes the number of
    (pair, dimension) products added up."""
    import numpy as np
    d = q.shape[1]
    qf, columns = q.astype(np.float64), np.ascontiguousarray(c.T.astype(np.float64))
    mass = (columns ** 2).sum(axis=0)
    slack = 4e-16 * max(d, 1)  # of sums of d products, relative to the norms
    weight = np.sqrt((columns ** 2).sum(axis=1))
    wide = bool(len(q) and np.sqrt((qf ** 2).sum(axis=1).max() * mass.max(initial=0)) >= 2.0 ** 62)
    found, work = [], 0
    for i, x in enumerate(qf):
        order = np.argsort(-np.abs(x) * weight, kind="stable")
        x = x[order]
        left = np.sqrt(np.append(np.cumsum((x ** 2)[::-1])[::-1], 0.0))
        margin = slack * left[0] * np.sqrt(mass) + 1e-6
        alive = np.flatnonzero((crow != qrow[i]) | (copies > 1))
        part, rest = np.zeros(len(alive)), mass[alive]
        floor = -np.inf if floors is None else floors[i]
        for lo in range(0, d, DIMS):
            hi = min(lo + DIMS, d)
            block = columns[np.ix_(order[lo:hi], alive)] if len(alive) < len(crow) else columns[order[lo:hi]]
            part = part + x[lo:hi] @ block
            work += block.size
            if hi == d:
                continue
            rest = rest - (block * block).sum(axis=0)
            if len(alive) > k:
                first = np.argpartition(part, -k)[-k:]
                lead = alive[first]
                whole = part[first] + x[hi:] @ columns[np.ix_(order[hi:], lead)]
                work += k * (d - hi)
                floor = max(floor, float((whole - margin[lead]).min()))
            spare = left[hi] * np.sqrt(np.maximum(rest, 0) + slack * mass[alive]) + margin[alive]
            stay = part + spare >= floor
            if not stay.all():
                alive, part, rest = alive[stay], part[stay], rest[stay]
        if len(alive) > k:
            near = part + margin[alive]
            least = np.partition(part - margin[alive], -k)[-k]
            alive = alive[near >= max(floor, least)]
        if wide:
            score = np.array([sum(int(a) * int(b) for a, b in zip(q[i], row)) for row in c[alive]], dtype=object)
        else:
            score = c[alive] @ q[i]
        best = np.array(sorted(range(len(alive)), key=lambda j: (-score[j], cid[alive[j]]))[:k], dtype=np.int64)
        found.append((np.full(len(best), i), alive[best], score[best]))
    if summed is not None:
        summed.append(work)
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(f) for f in zip(*found))


def _cell_kernel(k: int):
    def run(key, queries, candidates):
        import numpy as np
        import pyarrow as pa

        def load(t):
            flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return flat.astype(np.int64).reshape(len(t), -1) if len(t) else np.empty((0, 0), np.int64)

        def own(t, name):
            return t.column(name).to_numpy()
        q, c = load(queries), load(candidates)
        qi, ci, score = (np.empty(0, np.int64),) * 3
        if len(q) and len(c):
            qi, ci, score = best_pairs(q, own(queries, "query_row"), c, own(candidates, "row_id"), own(candidates, "vec_id"),
                                       own(candidates, "copies"), k, own(queries, "floor"))
            if len(score) and max(abs(int(s)) for s in score) >= 2 ** 63:
                raise OverflowError("a score does not fit a long")
        named = {"query_row": own(queries, "query_row")[qi], "query_id": own(queries, "query_id")[qi],
                 "query_copies": own(queries, "query_copies")[qi], "row_id": own(candidates, "row_id")[ci],
                 "vec_id": own(candidates, "vec_id")[ci], "copies": own(candidates, "copies")[ci],
                 "score": np.asarray([int(s) for s in score], np.int64)}
        return pa.table({n: pa.array(a, pa.int64()) for n, a in named.items()})
    return run


PAIRS = "query_row long, query_id long, query_copies long, row_id long, vec_id long, copies long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(row_id, vec_id, v, dim, copies) of the rows that take part, equal ones as one row with their number;
    written to the shared folder, so that row_id stays what it is."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("x"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where("vec_id is not null and x is not null").where(~F.exists("x", odd))
    whole = lambda x: F.when(F.abs(scale * x) < 2.0 ** 63, F.floor(scale * x)).otherwise(
        F.raise_error(F.lit("a component does not fit a long")).cast("long"))
    kinds = rows.select("vec_id", F.transform("x", whole).alias("v")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    return written(kinds.select(F.monotonically_increasing_id().alias("row_id"), "vec_id", "v", F.size("v").alias("dim"), "copies"), "quantised")


def _grid(queries: DataFrame, candidates: DataFrame, tasks: int, k: int) -> DataFrame:
    """The k best pairs of each query in each cell (dim, qb, cb) that both sides name."""
    cell = ["dim", "qb", "cb"]
    side = lambda df: df.repartition(max(1, min(TASKS, tasks)), *cell).groupBy(*cell)  # noqa: E731  a number, which AQE keeps
    return side(queries).cogroup(side(candidates)).applyInArrow(_cell_kernel(k), PAIRS)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, query_block: int = QUERY_BLOCK,
          candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """`queries`: rows of `candidates`, which is a table of `quantised`. query_id, rank (from 1), vec_id, score."""
    ship_package(candidates.sparkSession)
    nq = max(1, -(-queries.count() // query_block))
    nc = max(1, -(-candidates.count() // candidate_block))
    block = lambda n: F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int")
    every = lambda n, at=0: F.explode(F.sequence(F.lit(at), F.lit(n - 1)))
    left = queries.withColumn("qb", block(nq)).select(F.col("row_id").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("v"),
                                                      F.col("dim").alias("dim"), F.col("copies").alias("query_copies"), "qb")
    right = candidates.withColumn("cb", block(nc)).withColumn("qb", every(nq))
    none = F.lit(float("-inf"))
    pairs = written(_grid(left.withColumns({"cb": F.lit(0), "floor": none}), right.where("cb = 0"), nq, k), "topk-first")
    if nc > 1:
        floors = pairs.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least"))
        left = left.join(floors, "query_row", "left").withColumn("floor", F.when(F.col("n") >= k, F.col("least") - F.abs("least") * 1e-15).otherwise(none))
        pairs = pairs.union(_grid(left.withColumn("cb", every(nc, 1)).drop("n", "least"), right.where("cb > 0"), 2 * nq * (nc - 1), k))
    # of k rows at most k kinds are wanted; the number of rows before a kind says whether it still counts
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row_id")
    kinds = pairs.withColumn("kind", F.row_number().over(order)).where(F.col("kind") <= k)
    count = F.col("copies") - F.when(F.col("row_id") == F.col("query_row"), 1).otherwise(0)
    kinds = kinds.withColumn("copies", count).withColumn("before", F.sum("copies").over(order) - F.col("copies"))
    ranked = kinds.where(F.col("before") < k).select(
        "query_id", "query_copies", "vec_id", "score", F.explode(F.sequence(F.col("before") + 1, F.least(F.lit(k), F.col("before") + F.col("copies")))).alias("rank"))
    each = F.explode(F.sequence(F.lit(1), F.col("query_copies")))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", each.alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the five nearest of every 50th vector."""
    rows = quantised(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
    return top_k(rows.where("vec_id % 50 = 0"), rows)


ORACLE_SQL = """
with v as materialized (
  select row_number() over () as rn, vec_id, [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.rn, q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
  from v q join v c on len(q.v) = len(c.v) and q.rn <> c.rn where q.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by rn order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
