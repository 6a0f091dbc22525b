import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from dualspace.operators import embedders, report, runner
from dualspace.session import checkpoint_dir
from dualspace.sources.fixtures import chunk_vectors, gold_support, query_vectors


def _inputs(spark):
    c, q = chunk_vectors(spark, SF_SMALL), query_vectors(spark, SF_SMALL)
    questions = q.select("qid", "pool_id", F.lit("q").alias("query"), F.lit("unknown").alias("gold_answer"))
    chunks = c.select("pool_id", "chunk_idx", F.lit("c. d").alias("text"))
    return c, q, questions, chunks, gold_support(c, q)


def test_run_grid_appends_only_missing_rows_and_sinks(spark):
    c, q, questions, chunks, gold = _inputs(spark)
    out = f"{checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"
    cells = [runner.CellConfig("emb", "table", "cosine_x", "naive", 4),
             runner.CellConfig("emb", "none", "none", "no_context", 4)]
    assert runner.run_grid(cells, questions, chunks, gold, c, q, out) == 2
    n = spark.read.parquet(out).count()
    assert n == 2 * q.count()
    assert runner.run_grid(cells, questions, chunks, gold, c, q, out) == 0        # G2: nothing pending
    assert spark.read.parquet(out).count() == n
    r = runner.read_results(spark, out, ["dataset", "embedder", "metric", "strategy", "d", "qid"])   # S8
    assert r.columns == ["dataset", "embedder", "metric", "strategy", "d", "qid"]
    csv = f"{checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    runner.write_report_csv({"accuracy": report.table_accuracy(spark.read.parquet(out))}, csv)    # S9
    local = csv[len("file:"):] if csv.startswith("file:") else csv
    assert any(f.endswith(".csv") for f in os.listdir(f"{local}/accuracy"))


def test_table_and_callable_embedders(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "abcd"), (3, "")], "doc_id long, text string")

    def fn(texts, task):
        return np.array([[len(t), 1.0 if task == "RETRIEVAL_QUERY" else 0.0] for t in texts])

    emb = embedders.build_embedder("callable", fn, 2)
    v = {r.doc_id: list(r.vec) for r in emb(docs).collect()}
    assert np.allclose(v[2], [1.0, 0.0]) and np.allclose(v[3], [0.0, 0.0])     # L2 rows, zero row stays zero
    vq = {r.doc_id: list(r.vec) for r in emb(docs, task="RETRIEVAL_QUERY").collect()}
    assert not np.allclose(vq[1], v[1])                                           # task separation (E8)
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "key long, vec array<float>")
    t = embedders.build_embedder("table", table)(docs)
    assert sorted(r.doc_id for r in t.collect()) == [1, 2]
