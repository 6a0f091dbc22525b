import random
import zlib

import numpy as np

from dualspace.llm import quality as Q
from dualspace.llm.common import free_name


def make(rng, good):
    w = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(rng.randint(30, 120))]
    if good:
        return ". ".join(" ".join(w[i:i + 9]).capitalize() for i in range(0, len(w), 9)) + "."
    return rng.choice([" ".join([w[0]] * 60), " ".join(x.upper() + "!!" for x in w), " | ".join(w)])


def test_held_out_accuracy_and_prior(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, make(rng, i % 5 != 0), i % 5 != 0) for i in range(1500)]
    spark.createDataFrame([(i, t, "x", "y", 0.5) for i, t, _ in rows] + [(5000, None, "x", "y", 0.1), (5001, "", "x", "y", 0.1)],
                          "doc_id long, text string, lang string, source string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    # held-out labels are turned round: reading them would spoil the fit
    labels = [(i, int(g) if zlib.crc32(str(i).encode()) % 4 != 2 else int(not g)) for i, _, g in rows if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r["doc_id"]: r for r in Q.query(spark, str(tmp_path)).collect()}
    assert len(out) == 1502
    good = {i: g for i, _, g in rows}
    held = [i for i in good if out[i]["held_out"]]
    assert set(held) == {i for i in good if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([(out[i]["score"] >= 0.7) == good[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out.values())
    model = Q.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert 0.7 < model.prior < 0.9


def test_defined_cases(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = Q.train(docs, none)
    assert {r["_ds_score"] for r in Q.scored(docs, model).select("_ds_score").collect()} == {0.5}
    assert Q.scored(empty, Q.train(empty, none)).count() == 0
    assert np.isfinite(Q.features("")).all() and np.isfinite(Q.features("\ud800 \n\n x")).all()


def test_repeated_and_null_ids_and_clashing_columns(spark):
    rng = random.Random(9)
    rows = [(i, make(rng, i % 3 != 0)) for i in range(300)]
    hot = [(1, t) for _, t in rows[:200]] + [(None, rows[0][1])] * 50
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)], "doc_id long, quality int")
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    least = min([rows[1][1]] + [t for i, t in hot if i == 1], key=lambda t: list(Q.features(t)))
    once = Q.train(frame([(i, least if i == 1 else t) for i, t in rows]), labels)
    many = Q.train(frame(rows + hot), labels)  # the repeats of id 1 count once, null ids not at all
    assert np.allclose(once.score(np.array([Q.features(t) for _, t in rows])), many.score(np.array([Q.features(t) for _, t in rows])))
    clash = frame(rows).selectExpr("*", "1 as _ds_score", "2 as k", "3 as body", "true as positive")
    out = Q.scored(clash, Q.train(clash, labels), column=free_name(clash, "_DS_SCORE"))
    assert out.columns == [*clash.columns, "__DS_SCORE"] and out.where("_ds_score = 1 and __DS_SCORE between 0 and 1").count() == 300
