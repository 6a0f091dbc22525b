import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import SF_SMALL
from dualspace.operators import report, runner, store
from dualspace.session import checkpoint_dir
from dualspace.sources.fixtures import chunk_vectors, gold_support, query_vectors
from dualspace.sources.results import CELL, results_log
from dualspace.streaming.running import RunningMeans, start_incremental_embedding


def test_evaluate_cells_end_to_end(spark):
    c, q = chunk_vectors(spark, SF_SMALL), query_vectors(spark, SF_SMALL)
    questions = q.select(F.col("qid"), "pool_id", F.concat(F.lit("q"), F.col("qid").cast("string")).alias("query"),
                         F.lit("unknown").alias("gold_answer"))
    chunks = c.select("pool_id", "chunk_idx", F.concat(F.lit("chunk "), F.col("chunk_idx").cast("string"),
                                                       F.lit(". tail")).alias("text"))
    cells = [runner.CellConfig("emb", "table", "cosine_x", "naive", 4),
             runner.CellConfig("emb", "none", "none", "no_context", 4),
             runner.CellConfig("emb", "table", "mahalanobis", "decay", 4),
             runner.CellConfig("emb", "table", "euclidean", "ppr", 4)]
    rec = runner.evaluate_cells(cells, questions, chunks, gold_support(c, q), c, q).collect()
    nq = q.count()
    assert len(rec) == 4 * nq
    by = {}
    for r in rec:
        by.setdefault(r.strategy, []).append(r)
    assert all(r.n_retrieved == 0 and r.predicted == "unknown" and r.em == 1.0 for r in by["no_context"])
    assert all(r.n_retrieved == 5 and r.predicted.startswith("chunk ") for r in by["naive"])
    assert all(1 <= len(r.primary_ids) <= 5 and len(r.structural_ids) <= 10 for r in by["decay"])
    assert all(len(r.retrieved_ids) == 5 for r in by["ppr"])
    assert all(r.judge is None for r in rec)


def test_incremental_embedding_stream(spark):
    base = f"{checkpoint_dir(spark)}/g6-{uuid.uuid4().hex}"
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id long, text string")
    docs.repartition(4).write.parquet(f"{base}/src")
    vs = store.VectorStore(spark, f"{base}/store")

    def compute(todo):
        return todo.select("key", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("vec"))

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    q = start_incremental_embedding(spark, f"{base}/src", schema, vs, "m", 2, "t", compute, f"{base}/ckpt")
    q.awaitTermination()
    st = vs.stats().collect()
    assert st[0]["rows"] == 7          # every distinct text embedded once across micro-batches


def _means(df):
    return sorted((tuple(r[c] for c in CELL), r["seq"], r["running_f1"], r["running_judge"], r["running_retrieved"]) for r in df.collect())


def test_running_means_of_each_record_arrive_once(spark):
    log = results_log(spark, SF_SMALL)
    cut = log.agg(F.expr("percentile_approx(seq, array(0.3, 0.6))")).first()[0]
    parts = [log.where(F.col("seq") < cut[0]), log.where((F.col("seq") >= cut[0]) & (F.col("seq") < cut[1])), log.where(F.col("seq") >= cut[1])]
    base = f"{checkpoint_dir(spark)}/g5-{uuid.uuid4().hex}"
    sink = RunningMeans(f"{base}/means", block=37)
    for p in parts:  # the stream stops after each arrival and goes on from its checkpoint
        p.write.mode("append").parquet(f"{base}/src")
        sink.start(spark, f"{base}/src", log.schema, f"{base}/ckpt").awaitTermination()
    whole = _means(report.running_means(log))
    assert _means(sink.read(spark)) == whole
    sink.batch(parts[2], 2)  # run again: after all was written, and with another block size
    assert _means(sink.read(spark)) == whole
    RunningMeans(f"{base}/means", block=1000).batch(parts[1], 1)
    assert _means(sink.read(spark)) == whole


def test_an_epoch_without_totals_does_not_count(spark):
    log = results_log(spark, SF_SMALL)
    base = f"{checkpoint_dir(spark)}/g5-{uuid.uuid4().hex}"
    half = log.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    one, two = log.where(F.col("seq") < half), log.where(F.col("seq") >= half)
    sink = RunningMeans(base)
    sink.batch(one, 0)
    before = _means(sink.read(spark))
    report.running_means(two).write.parquet(f"{base}/records/epoch=1")  # a crash between the two writes
    assert _means(sink.read(spark)) == before
    sink.batch(two, 1)
    sink.batch(log.limit(0), 2)  # nothing arrived: the totals stay
    assert _means(sink.read(spark)) == _means(report.running_means(log))
    sink.batch(log.where("seq is null"), 3)
    assert spark.read.parquet(f"{base}/totals/epoch=3").agg(F.sum("_tn")).first()[0] == log.count()


def test_failing_answer_function_gives_error_rows(spark):
    c, q = chunk_vectors(spark, SF_SMALL), query_vectors(spark, SF_SMALL)
    questions = q.select("qid", "pool_id", F.col("qid").cast("string").alias("query"), F.lit("x").alias("gold_answer"))
    chunks = c.select("pool_id", "chunk_idx", F.lit("t").alias("text"))

    def fn(prompt):
        if prompt.endswith("Question: 0\nShort answer:"):
            raise RuntimeError("boom")
        return "x"

    cells = [runner.CellConfig("emb", "table", "cosine_x", "naive", 4)]
    rec = {r.qid: r for r in runner.evaluate_cells(cells, questions, chunks, gold_support(c, q), c, q,
                                                   answer_fn=fn).collect()}
    bad, good = rec[0], rec[25]
    assert bad.judge_rationale == "error: boom" and bad.predicted == "" and bad.f1 == 0.0
    assert bad.recall == 0.0 and bad.n_retrieved == 0
    assert good.predicted == "x" and good.em == 1.0 and good.n_retrieved == 5


def _inputs(spark):
    c, q = chunk_vectors(spark, SF_SMALL), query_vectors(spark, SF_SMALL)
    questions = q.select("qid", "pool_id", F.col("qid").cast("string").alias("query"), F.lit("x").alias("gold_answer"))
    chunks = c.select("pool_id", "chunk_idx", F.concat(F.lit("chunk "), F.col("chunk_idx").cast("string")).alias("text"))
    return c, q, questions, chunks, gold_support(c, q)


def test_data_sets_with_equal_ids_and_two_embedders(spark):
    c, q, questions, chunks, gold = _inputs(spark)
    turned = lambda df, col: df.withColumn(col, F.reverse(col))  # noqa: E731  another embedder: coordinates in reverse
    shifted = lambda df, col: df.withColumn(col, F.transform(col, lambda v, i: v * (i + 1)))
    both = lambda df, col: df.withColumn("embedder", F.lit("e1")).unionByName(shifted(df, col).withColumn("embedder", F.lit("e2")))
    sets = lambda df: df.withColumn("dataset", F.lit("a")).unionByName(df.withColumn("dataset", F.lit("b")))
    cells = [runner.CellConfig(d, e, "cosine_x", "naive", 4) for d in ("a", "b") for e in ("e1", "e2")]
    xb = both(c, "x").withColumn("dataset", F.lit("a")).unionByName(both(turned(c, "x"), "x").withColumn("dataset", F.lit("b")))
    rec = runner.evaluate_cells(cells, sets(questions), sets(chunks), sets(gold), xb, sets(both(q, "q"))).collect()
    assert len(rec) == 4 * q.count()
    alone = {("a", "e1"): (c, q), ("a", "e2"): (shifted(c, "x"), shifted(q, "q")), ("b", "e1"): (turned(c, "x"), q)}
    for (d, e), (xv, qv) in alone.items():
        one = runner.evaluate_cells([runner.CellConfig(d, e, "cosine_x", "naive", 4)], questions, chunks, gold, xv, qv).collect()
        assert {(r.qid, tuple(r.retrieved_ids)) for r in one} == {(r.qid, tuple(r.retrieved_ids)) for r in rec if (r.dataset, r.embedder) == (d, e)}
    with __import__("pytest").raises(ValueError):
        runner.evaluate_cells(cells, questions, chunks, gold, c, q)


def test_only_pending_questions_are_answered_and_stores_are_used(spark):
    from dualspace.operators.state import FitStore
    c, q, questions, chunks, gold = _inputs(spark)
    base = f"{checkpoint_dir(spark)}/grid-{uuid.uuid4().hex}"
    calls = spark.sparkContext.accumulator(0)

    def fn(prompt):
        calls.add(1)
        return "x"
    cells = [runner.CellConfig("emb", "table", "euclidean", "decay", 4)]
    n = q.count()
    kw = {"answer_fn": fn, "fits": FitStore(spark, f"{base}/fits"), "completions": store.CompletionStore(spark, f"{base}/answers")}
    most = questions.where("qid <> 0")
    assert runner.run_grid(cells, most, chunks, gold, c, q, f"{base}/out", **kw) == 1
    assert calls.value == n - 1
    assert runner.run_grid(cells, questions, chunks, gold, c, q, f"{base}/out", **kw) == 1
    assert calls.value == n  # one pending question, one call
    assert runner.run_grid(cells, questions, chunks, gold, c, q, f"{base}/out", **kw) == 0
    assert runner.read_results(spark, f"{base}/out").count() == n
    runner.run_grid(cells, questions, chunks, gold, c, q, f"{base}/other", **kw)
    assert calls.value == n  # the replies come from the store
    assert spark.read.parquet(f"{base}/fits/pca").count() == c.select("pool_id").distinct().count()
