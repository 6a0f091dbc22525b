"""Pair grid: split every pool into bounded blocks before any pairwise work.

A pool (shared corpus) may hold a third of all rows, so a pairwise operator
never groups by `pool_id` alone. Instead each side is cut into blocks of at
most ~`block` rows by hashing its id, and the other side is replicated over
the block ids of its pool. A (pool_id, lb, rb) group then holds at most a
left block and a right block, whatever the pool size: memory per task is
bounded by block², and a hot pool fans out over many tasks.

Block counts come from a per-pool partial aggregate (one row per pool) joined
back on pool_id; AQE turns that join into a broadcast when the stats side is
small at run time, and splits the hot pool's partition when it is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BLOCK = 4096


def pool_counts(df: DataFrame, name: str, key: str = "pool_id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def n_blocks(count_col: str, block: int):
    return F.greatest(F.lit(1), F.ceil(F.col(count_col) / F.lit(float(block)))).cast("int")


def wider(least: int, most: int, count_col: str, blocks: int):
    """The size of blocks: `least`, or larger, up to `most`, where rows would fill more than `blocks` of them."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.col(count_col) / blocks)))


def block_of(id_col: str, nb_col: str):
    """Stable block id in [0, nb) from a hash of the row id."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.col(nb_col).cast("bigint")).cast("int")


def pair_grid(left: DataFrame, left_id: str, right: DataFrame, right_id: str,
              left_block: int = DEFAULT_BLOCK, right_block: int = DEFAULT_BLOCK,
              key: str = "pool_id") -> tuple[DataFrame, DataFrame]:
    """Assign grid coordinates (lb, rb) to both sides of a within-pool pair join.

    left rows get lb = hash(left_id) mod nlb and are replicated over rb in [0, nrb);
    right rows get rb = hash(right_id) mod nrb and are replicated over lb in [0, nlb).
    """
    stats = (pool_counts(left, "_nl", key).join(pool_counts(right, "_nr", key), key)
             .select(key, n_blocks("_nl", left_block).alias("_nlb"), n_blocks("_nr", right_block).alias("_nrb")))
    lg = (left.join(stats, key)
          .withColumn("lb", block_of(left_id, "_nlb"))
          .withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("_nrb") - 1)))
          .drop("_nlb", "_nrb"))
    rg = (right.join(stats, key)
          .withColumn("rb", block_of(right_id, "_nrb"))
          .withColumn("lb", F.explode(F.sequence(F.lit(0), F.col("_nlb") - 1)))
          .drop("_nlb", "_nrb"))
    return lg, rg


def self_grid(df: DataFrame, id_col: str, block: int = DEFAULT_BLOCK,
              key: str = "pool_id") -> tuple[DataFrame, DataFrame]:
    """Grid of a pool against itself (i side and j side).

    The right side is a fresh projection so the self-join has distinct lineage."""
    twin = df.select(*[F.col(c).alias(c) for c in df.columns])
    return pair_grid(df, id_col, twin, id_col, block, block, key)


def stack_vectors(series) -> "np.ndarray":  # noqa: F821
    import numpy as np
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


def hash_order_key(id_col: str, seed) -> "Column":  # noqa: F821
    """Seeded, engine-portable shuffle key: md5('<seed>:<id>')."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(id_col).cast("string")))


def sample_per_pool(df: DataFrame, id_col: str, n: int, seed, key: str = "pool_id",
                    block: int = DEFAULT_BLOCK) -> DataFrame:
    """The n rows of each pool with the smallest seeded hash (all rows if fewer).

    Two-phase top-n: a local top-n per (pool, block) bounds the rows per task,
    then an exact top-n per pool runs over at most n rows per block.
    """
    from pyspark.sql import Window
    stats = pool_counts(df, "_n", key).select(key, n_blocks("_n", block).alias("_nb"))
    h = df.join(stats, key).withColumn("_h", hash_order_key(id_col, seed)).withColumn("_blk", block_of(id_col, "_nb"))
    local = h.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_blk").orderBy("_h", id_col))).where(
        F.col("_r") <= n)
    glob = local.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_h", id_col))).where(
        F.col("_r") <= n)
    return glob.drop("_nb", "_h", "_blk", "_r")


def ddl_type(df: DataFrame, col: str) -> str:
    """The DDL type of a column, used to declare kernel output schemas so ids of
    any type (integer pools, string question ids) pass through unchanged."""
    return df.schema[col].dataType.simpleString()


def ids(series) -> "np.ndarray":  # noqa: F821
    """Id column as a numpy array without forcing a type."""
    return series.to_numpy()


def frame_of(schema: str, rows: list[tuple]) -> "pd.DataFrame":  # noqa: F821
    """Rows as a pandas frame with the column names of a DDL schema."""
    import pandas as pd
    names = [c.strip().split(" ", 1)[0] for c in schema.split(", ")]
    return pd.DataFrame(rows, columns=names) if rows else pd.DataFrame({n: pd.Series(dtype=object) for n in names})


def add_arrays(parts: DataFrame, keys: list[str], value: str, schema: str) -> DataFrame:
    """Sums of equally long arrays by key, added as they stream by: one array in memory."""
    import numpy as np

    def run(batches):
        at, total = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if at is not None and at == tuple(r[:-1]):
                    total += np.asarray(r[-1], dtype=np.float64)
                else:
                    if at is not None:
                        out.append((*at, total))
                    at, total = tuple(r[:-1]), np.array(r[-1], dtype=np.float64)
            yield frame_of(schema, out)
        if at is not None:
            yield frame_of(schema, [(*at, total)])
    return parts.select(*keys, value).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
