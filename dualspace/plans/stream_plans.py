"""Registered streaming plans (G5) over the events-derived results log, in the session's shared checkpoint folder.

`stream_cell_means`: the log as Parquet files in seq order, one file per micro-batch; the final state is returned.
`stream_running_means`: the log arrives in stretches; after each the stream is started anew from its checkpoint, and the
running means of every record are returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dualspace.session import checkpoint_dir
from dualspace.sources.results import results_log
from dualspace.streaming.running import RunningMeans, start_running_means

N_FILES = 8
ARRIVALS = 4


COLUMNS = ("dataset", "embedder", "metric", "strategy", "d", "qid", "f1", "judge", "n_retrieved", "seq")


def q_stream_running_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    r = results_log(spark, sf_dir).select(*COLUMNS)
    first, last = r.agg(F.min("seq"), F.max("seq")).first()
    sink = RunningMeans(f"{base}/means")
    width = ((last or 0) - (first or 0)) // ARRIVALS + 1
    for i in range(ARRIVALS):
        start = (first or 0) + i * width
        stretch = r.where((F.col("seq") >= start) & (F.col("seq") < start + width))
        stretch.write.mode("append").parquet(f"{base}/source")
        sink.start(spark, f"{base}/source", r.schema, f"{base}/ckpt").awaitTermination()
    return sink.read(spark).drop("epoch")


def q_stream_cell_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    r = results_log(spark, sf_dir).select(*COLUMNS)
    (r.repartitionByRange(N_FILES, "seq").sortWithinPartitions("seq")
      .write.mode("overwrite").parquet(f"{base}/source"))
    name = f"cell_means_{uuid.uuid4().hex[:8]}"
    q = start_running_means(spark, f"{base}/source", r.schema, name, f"{base}/ckpt")
    q.awaitTermination()
    return spark.table(name).select("dataset", "embedder", "metric", "strategy", "d", "n",
                                    "running_f1", "running_judge", "running_retrieved")


QUERIES = {"stream_cell_means": q_stream_cell_means, "stream_running_means": q_stream_running_means}
