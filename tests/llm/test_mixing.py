import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dualspace.llm import mixing as M


def test_period_keeps_windows_and_deviates_by_less_than_a_block():
    rng = random.Random(6)
    for _ in range(40):
        w = {f"s{i}": rng.randint(1, 9) for i in range(rng.randint(1, 9))}
        total, ran = sum(w.values()), Counter()
        for t, s in enumerate(M.period(w), 1):
            j = ran[s]
            assert j * total // w[s] <= t - 1 < -(-(j + 1) * total // w[s])
            ran[s] += 1
            assert all(abs(ran[x] - t * a / total) < 1 for x, a in w.items())
        assert dict(ran) == w


def simulate(weights, blocks):
    """Slot by slot, with no period: [(source, block)] and the first slot of each phase."""
    left, out, starts = {s: blocks.get(s, 0) for s in weights}, [], []
    while any(left.values()):
        own = {s: a for s, a in weights.items() if left[s]}
        total, ran, t = sum(own.values()), Counter(), 0
        starts.append(len(out))
        while all(left[s] for s in own):
            s = min((s for s in own if ran[s] * total // own[s] <= t), key=lambda s: math.ceil((ran[s] + 1) * total / own[s]))
            out.append((s, blocks[s] - left[s]))
            ran[s] += 1
            left[s] -= 1
            t += 1
    return out, starts


@pytest.mark.parametrize("weights", [{"src0": 3, "src1": 1, "src2": 2, M.OTHER: 1}, M.WEIGHTS])
def test_mix_equals_a_slot_by_slot_simulation(spark, docs, corpus, weights):
    rows = M.mix(docs.withColumn("slot", F.lit("x")), weights, block_rows=3, bucket_rows=7).collect()
    assert len(rows) == len(corpus)
    entry = lambda s: s if s in weights else M.OTHER
    sizes = Counter(entry(r[3]) for r in corpus)
    plan, starts = simulate(weights, {s: -(-n // 3) for s, n in sizes.items()})
    got = {}
    for r in rows:
        s = entry(r["source"])
        assert plan[r["slot"]] == (s, r["block"])
        assert r["release"] <= r["slot"] < r["deadline"] and starts[r["phase"]] <= r["slot"]
        got.setdefault(s, []).append((r["block"], r["offset"], -1 if r["doc_id"] is None else r["doc_id"]))
    for s, places in got.items():
        assert [(b, o) for b, o, _ in sorted(places)] == [(i // 3, i % 3) for i in range(sizes[s])]
        spread = [i % M.PRIME * M.FACTOR % M.PRIME for _, _, i in sorted(places)]
        assert spread == sorted(spread)


def test_order_columns_and_empty_table(spark, docs, empty):
    out = M.mixed_order(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    clash = docs.withColumn("slot", F.col("doc_id") + 7).withColumn("offset", F.lit("o"))
    out = M.mixed_order(clash)
    assert out.dtypes == clash.dtypes
    assert sorted(map(str, out.collect())) == sorted(map(str, clash.collect()))
    places = {r["doc_id"]: (r["slot"], r["offset"]) for r in M.mix(docs).where("doc_id <> 205").collect()}
    order = [places[r["doc_id"]] for r in out.collect() if r["doc_id"] in places]
    assert order == sorted(order)
    assert M.mix(empty).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "src0"), (-5, "src0")], "doc_id long, source string")
    assert M.mix(nulls).count() == 3
