"""Structured Streaming twins of the runner's live counters.

G5: results arrive as Parquet files; a streaming aggregation keeps, per cell,
the running count and sums of f1, judge (NULL as 0) and n_retrieved, from
which the running means are read. The final state equals the batch
`report.cell_summary` means. `RunningMeans` gives the running means of every
record as it arrives, which an aggregation's end state does not hold: each
micro-batch is one epoch of a ledger in a file sink.

G6: documents arrive as files; every micro-batch runs the vector store's
miss-only embedding (`VectorStore.get_or_compute`) in `foreachBatch`. The
store is idempotent by key, so a replayed micro-batch adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dualspace.operators import report

CELL = ["dataset", "embedder", "metric", "strategy", "d"]


def running_cell_means(stream: DataFrame) -> DataFrame:
    """Un-windowed streaming aggregate of a results stream -> running means per cell."""
    j = F.when(F.isnan("judge"), F.lit(None)).otherwise(F.col("judge"))
    return stream.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("f1").alias("running_f1"),
        F.avg(F.coalesce(j, F.lit(0.0))).alias("running_judge"),
        F.avg("n_retrieved").alias("running_retrieved"))


def start_running_means(spark: SparkSession, source: str, schema, sink_name: str, checkpoint: str,
                        files_per_trigger: int = 1) -> StreamingQuery:
    """Read result files as they land, keep the running means in a memory table.
    availableNow drains what is there in micro-batches and stops."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source))
    return (running_cell_means(src).writeStream.outputMode("complete").format("memory")
            .queryName(sink_name).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


class RunningMeans:
    """The running means of every arriving record, exactly once.

    Under `path`, epoch N has the records of micro-batch N with their running means (`records/epoch=N`) and,
    written after them, the totals of each cell up to and with it (`totals/epoch=N`). A batch starts
    from the totals of the epoch before its own and overwrites its own, so a batch that is run again after a crash,
    at whatever point, leaves the same rows once. An epoch counts when its totals are there; `read` leaves out
    the others. The state is one row per cell, a table and no operator state: a hot cell's records go through
    report.running_means, whose ranges are summed by many tasks, not through one task per key.

    Records are ordered by epoch, then by `order`. A path belongs to one checkpoint: a new
    checkpoint counts its batches from 0. Defined cases: a batch without records adds none and keeps the totals; a null or NaN judge
    counts 0; records of equal `order` in one cell are ordered arbitrarily; other columns are ignored; `read`
    raises before the first epoch, as there is no path yet."""

    def __init__(self, path: str, order: str = "seq", block: int = 65536):
        self.path, self.order, self.block = path.rstrip("/"), order, block

    def _ledger(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/totals")

    def batch(self, df: DataFrame, epoch: int) -> None:
        """One micro-batch; safe to run again with the same rows."""
        spark, earlier, totals = df.sparkSession, None, report.running_totals(df)
        if epoch:
            past = self._ledger(spark).where(F.col("epoch") < epoch)
            last = past.agg(F.max("epoch")).first()[0]
            earlier = past.where(F.col("epoch") == last).drop("epoch")
            both = totals.unionByName(earlier)
            totals = both.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in report.TOTALS])
        means = report.running_means(df, self.order, self.block, earlier)
        means.write.mode("overwrite").parquet(f"{self.path}/records/epoch={epoch}")
        totals.write.mode("overwrite").parquet(f"{self.path}/totals/epoch={epoch}")

    def start(self, spark: SparkSession, source: str, schema, checkpoint: str, files_per_trigger: int | None = None) -> StreamingQuery:
        """Work off the result files that have landed since the checkpoint, then stop."""
        reader = spark.readStream.schema(schema)
        if files_per_trigger is not None:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        return (reader.parquet(source).writeStream.foreachBatch(self.batch)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

    def read(self, spark: SparkSession) -> DataFrame:
        """The records of the epochs that count, with their running means."""
        done = self._ledger(spark).select("epoch").distinct()
        return spark.read.parquet(f"{self.path}/records").join(done, "epoch", "left_semi")


def start_incremental_embedding(spark: SparkSession, source: str, schema, store, model: str, dim: int,
                                task: str, compute, checkpoint: str, key: str = "doc_id",
                                text: str = "text") -> StreamingQuery:
    """Embed arriving documents into the store, misses only, per micro-batch."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def batch(df: DataFrame, epoch: int) -> None:
        store.get_or_compute(df, model, dim, task, compute, key=key, text=text).count()

    return (src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
