"""Content-addressed vector store on Parquet.

Layout: `<path>/model=<m>/dim=<d>/task=<t>/part-*.parquet` with columns
(key, vec). A lookup prunes to one partition. Only misses are computed:
requested keys are deduplicated, anti-joined against the store, embedded by
the user's batch function, appended (an atomic Parquet job commit), and
joined back. Appends are idempotent by key: a key written twice by racing
writers is read once (`dropDuplicates(key)` on read).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUL = "\u0000"


def content_key(text, model: str, dim: int, task: str) -> Column:
    """sha1(text NUL model NUL dim NUL task NUL) as hex."""
    t = F.col(text) if isinstance(text, str) else text
    return F.sha1(F.concat(t, F.lit(NUL), F.lit(model), F.lit(NUL), F.lit(str(dim)), F.lit(NUL),
                           F.lit(task), F.lit(NUL)))


def misses(requested: DataFrame, stored_keys: DataFrame) -> DataFrame:
    """Distinct requested (key, text) rows whose key is not stored yet."""
    return requested.dropDuplicates(["key"]).join(stored_keys.select("key"), "key", "left_anti")


class VectorStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _exists(self) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(p)

    def _stored(self, model: str | None = None, dim: int | None = None, task: str | None = None) -> DataFrame:
        """Stored rows as they lie there, pruned to the given partition."""
        schema = "key string, vec array<float>, model string, dim int, task string"
        if not self._exists():
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(self.path)
        for column, value in (("model", model), ("dim", dim), ("task", task)):
            df = df if value is None else df.where(F.col(column) == value)
        return df

    def read(self, model: str | None = None, dim: int | None = None, task: str | None = None,
             keys: DataFrame | None = None) -> DataFrame:
        """Stored rows (model, dim, task, key, vec), deduplicated by key; with `keys` (key)
        only the requested ones are shuffled and deduplicated."""
        df = self._stored(model, dim, task)
        if keys is not None:
            df = df.join(keys.select("key"), "key", "left_semi")
        return df.dropDuplicates(["model", "dim", "task", "key"])

    def get_or_compute(self, docs: DataFrame, model: str, dim: int, task: str,
                       compute: Callable[[DataFrame], DataFrame], key: str = "doc_id",
                       text: str = "text") -> DataFrame:
        """One row (key, vec) for every row of docs(key, text), computing only misses.

        compute(df(key, text)) -> df(key, vec ARRAY<FLOAT>). Nothing is appended when
        nothing is missing; the result is unordered (rows carry their key)."""
        from dualspace.session import cut_lineage
        keyed = docs.select(key, text).withColumn("_ck", content_key(text, model, dim, task))
        wanted = keyed.select(F.col("_ck").alias("key"))
        todo = cut_lineage(misses(keyed.select(F.col("_ck").alias("key"), F.col(text).alias("text")),
                                  self._stored(model, dim, task)))
        if not todo.isEmpty():
            (compute(todo).select("key", F.col("vec").cast("array<float>").alias("vec"))
                .withColumn("model", F.lit(model)).withColumn("dim", F.lit(dim)).withColumn("task", F.lit(task))
                .write.mode("append").partitionBy("model", "dim", "task").parquet(self.path))
        vecs = self.read(model, dim, task, wanted).select(F.col("key").alias("_ck"), "vec")
        return keyed.join(vecs, "_ck", "left").select(key, "vec")

    def stats(self) -> DataFrame:
        """Rows and vector bytes per (model, dim, task)."""
        keys = self._stored().select("model", "dim", "task", "key", F.size("vec").alias("n")).dropDuplicates(
            ["model", "dim", "task", "key"])  # the vectors stay where they are
        return keys.groupBy("model", "dim", "task").agg(
            F.count(F.lit(1)).alias("rows"), F.sum(F.lit(4) * F.col("n")).alias("bytes"))


FINGERPRINT_BLOCK = 1024


def corpus_fingerprint(chunks: DataFrame, pool: str = "pool_id", idx: str = "chunk_idx",
                       text: str = "text", block: int = FINGERPRINT_BLOCK) -> DataFrame:
    """Not the reference's value (see `corpus_fingerprint_reference`), but order-sensitive
    and parallel within a pool: sha1 over every chunk text
    followed by NUL, per block of `block` consecutive indices, then sha1 over the blocks'
    hashes in order, first 16 hex digits. A fold holds one block of texts, or 40
    characters per block."""
    fold = lambda c, v: F.array_join(F.transform(F.sort_array(c), lambda e: v(e)), "")
    leaves = chunks.groupBy(pool, F.floor(F.col(idx) / block).alias("_b")).agg(F.collect_list(F.struct(idx, text)).alias("_c"))
    leaves = leaves.select(pool, "_b", F.sha1(fold("_c", lambda e: F.concat(e[text], F.lit(NUL)))).alias("_h"))
    tops = leaves.groupBy(pool).agg(F.collect_list(F.struct("_b", "_h")).alias("_c"))
    return tops.select(pool, F.substring(F.sha1(fold("_c", lambda e: e["_h"])), 1, 16).alias("fingerprint"))


def _fingerprint_kernel(batches):
    import hashlib

    import pyarrow as pa
    pool, state = None, None  # the open pool and its hash
    for b in batches:
        done = []
        for p, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if state is None or p != pool:
                if state is not None:
                    done.append((pool, state.hexdigest()[:16]))
                pool, state = p, hashlib.sha1()
            state.update(text.encode("utf-8"))
            state.update(b"\0")
        kind = b.schema.field(0).type
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], kind), pa.array([x[1] for x in done], pa.string())],
                                             names=["pool", "fingerprint"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pool], kind), pa.array([state.hexdigest()[:16]], pa.string())],
                                         names=["pool", "fingerprint"])


def corpus_fingerprint_reference(chunks: DataFrame, pool: str = "pool_id", idx: str = "chunk_idx",
                                 text: str = "text") -> DataFrame:
    """E11, the reference's own value: sha1 over every chunk text followed by NUL in index
    order, first 16 hex digits; null texts are left out. Each pool streams through one task
    that holds only the open hash; sha1 is serial, so a pool is never split over tasks."""
    rows = chunks.where(F.col(text).isNotNull()).select(F.col(pool).alias("_p"), F.col(text).cast("string").alias("_t"), F.col(idx).alias("_i"))
    rows = rows.repartition("_p").sortWithinPartitions("_p", "_i", "_t").select("_p", "_t")
    return rows.mapInArrow(_fingerprint_kernel, f"pool {dict(rows.dtypes)['_p']}, fingerprint string").withColumnRenamed("pool", pool)


def corpus_fingerprint_commutative(chunks: DataFrame, pool: str = "pool_id", idx: str = "chunk_idx",
                                   text: str = "text") -> DataFrame:
    """E11 for pools of any size: the sum (as a 38-digit decimal) of
    xxhash64(idx, text) — still sensitive to which text sits at which index,
    computed with a map-side partial aggregate."""
    return chunks.groupBy(pool).agg(
        F.sum(F.xxhash64(idx, text).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


class CompletionStore:
    """Answers and judge replies keyed by sha1(parts NUL...)[:24], kept in a
    Parquet table (key, model, text). Only keys that are not stored reach the
    user's batch function (a Python callable over Arrow batches in mapInPandas,
    e.g. a model client); results are appended and joined back."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def read(self) -> DataFrame:
        vs = VectorStore(self.spark, self.path)
        if not vs._exists():
            return self.spark.createDataFrame([], "key string, model string, text string")
        return self.spark.read.schema("key string, model string, text string").parquet(self.path) \
            .dropDuplicates(["key"])

    def complete(self, requests: DataFrame, key: Column, payload: str, model: str,
                 fn: Callable[[list[str]], list[str]], clean: Callable[[Column], Column] | None = None) -> DataFrame:
        """requests(..., payload) -> requests + `text`, computing only unseen keys.
        fn maps a list of payload strings to a list of replies."""
        keyed = requests.withColumn("_key", key)
        todo = keyed.select(F.col("_key").alias("key"), F.col(payload).alias("payload")).dropDuplicates(["key"]) \
            .join(self.read().select("key"), "key", "left_anti")

        def run(batches):
            import pandas as pd
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({"key": pdf["key"], "text": list(fn(pdf["payload"].tolist()))})

        new = todo.mapInPandas(run, "key string, text string")
        if clean is not None:
            new = new.withColumn("text", clean(F.col("text")))
        new.withColumn("model", F.lit(model)).select("key", "model", "text").write.mode("append").parquet(self.path)
        got = self.read().select(F.col("key").alias("_key"), "text")
        return keyed.join(got, "_key", "left").drop("_key")
