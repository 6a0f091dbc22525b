import corpus_pipeline


def test_stages_compose(spark, docs, empty, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.selectExpr("doc_id", "cast(doc_id % 7 != 0 as int) as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    now, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, sf)
        assert after.dtypes == now.dtypes
        now = after.cache()
    ids = {r["doc_id"] for r in now.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert {r["doc_id"] for r in packed.collect()} == ids
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_near_duplicates_keep_one_of_each_class(spark, docs, corpus):
    from tests.llm.test_simhash import brute_components
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    assert got == sorted({c for _, _, c in brute_components([(r[0], r[1]) for r in corpus])})


def test_sequences_follow_the_mix(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F
    from dualspace.llm import mixing, packing
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])  # run(): mix, then pack
    long = "ab " * 9000
    rows = [(i, long if i % 50 == 0 else "ab " * (1 + i % 300), "src0" if i % 20 else "src1") for i in range(8000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    source, length = {r[0]: r[2] for r in rows}, {}
    assert len({(r["doc_id"], r["start"]) for r in out}) == len(out) and {r["doc_id"] for r in out} == set(source)
    for r in out:
        length[r["sequence_id"]] = length.get(r["sequence_id"], 0) + r["length"]
    assert max(length.values()) <= packing.CAPACITY
    assert sum(length.values()) == sum(r["doc_tokens"] for r in out if r["start"] == 0)
    place = {r["doc_id"]: r["p"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
             .select("doc_id", mixing.position().alias("p")).collect()}
    reach, by_seq = packing.GROUP_PIECES, {}
    for r in out:
        by_seq.setdefault(r["sequence_id"], []).append(place[r["doc_id"]])
    seen = -1
    for _, p in sorted(by_seq.items()):  # no sequence lies more than a stretch before or behind another's documents
        assert max(p) // reach == min(p) // reach >= seen
        seen = min(p) // reach
    # while src1's 400 documents last it has a seventh of the places (weights 6 and 1): the last are in the fourth stretch
    ordered = sorted((r["sequence_id"], r["offset"], r["doc_id"]) for r in out if r["start"] + r["length"] == r["doc_tokens"])
    first = [source[d] for _, _, d in ordered[:2 * reach]]
    assert abs(first.count("src1") / len(first) - 1 / 7) < 0.04
    assert all(source[d] == "src0" for _, _, d in ordered[4 * reach:])


def test_near_duplicates_keep_null_and_repeated_ids_of_unlike_texts(spark):
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in ("ore", "fig", "elm", "yew", "oak")]
    rows = [(None, texts[0], "a"), (None, texts[1], "a"), (None, texts[1], "a"), (5, texts[2], "a"), (5, texts[3], "a"),
            (7, texts[0], "b"), (3, texts[4], "a"), (3, texts[4], "b"), (None, None, "a"), (None, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for given in (docs, docs.repartition(4), docs.orderBy("source", "text")):
        got = [tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, given, "").collect()]
        assert sorted(t or "" for _, t, _ in got) == sorted([*texts, ""])  # one row of each component
        assert {(5, texts[2], "a"), (5, texts[3], "a"), (7, texts[0], "b"), (None, texts[1], "a")} <= set(got)


def test_stages_keep_columns_of_any_name(spark, docs, tmp_path):
    odd = ["_ds_score", "_ds_text", "_ds_row", "_ds_id", "_ds_blob", "_ds_findings", "_ds_entry", "slot", "phase"]
    named = docs.selectExpr("*", *[f"concat('{n}', doc_id) as {n}" for n in odd])
    docs.selectExpr("doc_id", "1 as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, named, str(tmp_path))
        assert out.columns == named.columns
        assert all(r[n] == (None if r["doc_id"] is None else f"{n}{r['doc_id']}") for r in out.collect() for n in odd)
    assert corpus_pipeline.STAGES[-1][1](spark, named, str(tmp_path)).count() >= docs.count()
