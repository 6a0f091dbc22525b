import uuid

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from dualspace.operators import prompts as P
from dualspace.operators import report, store
from dualspace.session import checkpoint_dir
from dualspace.sources.results import results_log


def test_judge_parse_cases(spark):
    rows = [("{\"correct\": true, \"rationale\": \"ok\"}",), ("no json here",), ("{\"correct\": tru",),
            ("x {\"rationale\": \"r\"} y",), ("a\n{\n \"correct\": true\n}\n",), ("{\"correct\": \"false\"}",)]
    df = spark.createDataFrame(rows, "raw string").select(P.parse_judge("raw").alias("j")).select("j.*")
    r = df.collect()
    assert [x.correct for x in r] == [True, False, False, False, True, False]
    assert [x.rationale for x in r] == ["ok", "judge parse failed", "judge parse failed", "r", "", ""]
    assert r[1].raw == "no json here" and r[0].raw is None


def test_prompt_and_stub_answer(spark):
    q = spark.createDataFrame([("q1", "p", "Who?", "decay"), ("q2", "p", "What?", "no_context")],
                              "qid string, pool_id string, query string, strategy string")
    ch = spark.createDataFrame([("p", 0, "Alpha one. More"), ("p", 1, "Beta")], "pool_id string, chunk_idx int, text string")
    r = spark.createDataFrame([("q1", "p", "primary", 1, 0)], "qid string, pool_id string, role string, rank int, chunk_idx int")
    out = {x.qid: x for x in P.build_prompts(q, r, ch).select("qid", "prompt", P.extractive_answer("prompt").alias("a")).collect()}
    assert "- Alpha one. More\n</primary_semantic_context>" in out["q1"].prompt
    assert "<structurally_linked_context>\n(none)\n" in out["q1"].prompt
    assert out["q1"].a == "Alpha one" and out["q2"].a == "unknown"


def test_store_computes_only_misses(spark):
    path = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    vs = store.VectorStore(spark, path)
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id int, text string")
    seen = []

    def compute(todo):
        seen.append(todo.count())
        return todo.select("key", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("vec"))

    out = vs.get_or_compute(docs, "m", 2, "t", compute).collect()
    assert sorted(r.doc_id for r in out) == [1, 2, 3] and all(r.vec is not None for r in out)
    vs.get_or_compute(docs, "m", 2, "t", compute).collect()
    assert seen == [2]                         # deduped in batch, nothing recomputed
    assert vs.stats().collect()[0]["rows"] == 2


def test_stream_final_state_equals_batch(spark):
    from dualspace.plans.stream_plans import q_stream_cell_means
    s = {tuple(r[:5]): (r.n, r.running_f1) for r in q_stream_cell_means(spark, SF_SMALL).collect()}
    b = {tuple(r[:5]): (r.n, r.mean_f1) for r in report.cell_summary(results_log(spark, SF_SMALL)).collect()}
    assert s == b


def test_running_means_blocked_equals_window(spark):
    from pyspark.sql import Window
    r = results_log(spark, SF_SMALL)
    a = {(tuple(x[:5]), x.seq): x.running_f1 for x in report.running_means(r, block=37).collect()}
    w = Window.partitionBy(*report.CELL).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    b = {(tuple(x[:5]), x.seq): x.f for x in r.select(*report.CELL, "seq", F.avg("f1").over(w).alias("f")).collect()}
    assert a == b


def test_completion_store_calls_only_misses(spark):
    from dualspace.functions.text import clean_answer
    path = f"{checkpoint_dir(spark)}/answers-{uuid.uuid4().hex}"
    cs = store.CompletionStore(spark, path)
    req = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p1")], "id int, prompt string")
    calls = []

    def fn(prompts):
        calls.append(len(prompts))
        return [f'"{p.upper()}".' for p in prompts]

    key = P.answer_key("prompt", F.lit("m"))
    out = {r.id: r.text for r in cs.complete(req, key, "prompt", "m", fn, clean_answer).collect()}
    assert out == {1: "P1", 2: "P2", 3: "P1"}
    cs.complete(req, key, "prompt", "m", fn, clean_answer).collect()
    assert spark.read.parquet(path).count() == 2      # the second call found every key stored


def test_reference_fingerprint(spark):
    import hashlib
    from dualspace.operators.store import corpus_fingerprint_reference
    rows = [(p, i, f"é {p} {i}" if i % 7 else "") for p in (None, 1, 2, 3) for i in range(3000 if p == 2 else 9)]
    chunks = spark.createDataFrame([*rows[::-1], (1, 4, None)], "pool_id int, chunk_idx int, text string")
    got = {r["pool_id"]: r["fingerprint"] for r in corpus_fingerprint_reference(chunks).collect()}
    assert got == {p: hashlib.sha1("".join(t + "\0" for q, _, t in rows if q == p).encode()).hexdigest()[:16] for p in (None, 1, 2, 3)}
