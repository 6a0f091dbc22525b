import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dualspace.llm import packing as P

TOK = P.tokenizer_path()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(TOK)


def test_words_equal_the_tokenizer(tokenizer):
    rng = random.Random(1)
    texts = ["", "don't I'LL x's 'tis", "ABC!!def...  12a3b  é É\xa0x\x85y", "a\x1cb", "<|endoftext|> <|ENDOFTEXT|>", "İ ß ﬁ ½ ² ª'm",
             "日本 語 é", "--''--", "The ore, Wh. (ere) \"x\""] + ["".join(rng.choices([chr(i) for i in range(9, 256)], k=60)) for _ in range(300)]
    words = P.WordIds(TOK, cache_words=50)
    for t in texts * 2:
        assert words.encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_differencing_is_a_near_equal_partition():
    rng = random.Random(3)
    for n, k in ((1, 3), (10, 3), (200, 20), (200, 60)):
        lengths = [rng.randint(1, 900) for _ in range(n)]
        found = P.difference(lengths, k)
        assert len(found) <= k and sorted(i for w in found for i in w) == list(range(n))
        if n == 200:
            sums = [sum(lengths[i] for i in w) for w in found]
            assert max(sums) <= 1.1 * sum(lengths) / k
    assert P.difference([], 4) == [] and P.windows([], 10) == []
    assert all(sum(w) <= 10 for w in P.windows([7, 7, 7, 3, 3], 10))


def test_query_is_an_exact_round_trip(spark, docs, corpus, tokenizer, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [r.asDict() for r in P.query(spark, str(tmp_path)).collect()]
    want = {}
    for r in corpus:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.setdefault(r[0], []).append(ids)
    by_doc, by_seq = {}, {}
    for r in rows:
        ids = want[r["doc_id"]][0]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes())
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, texts in want.items():
        assert sorted(by_doc[d]) == sorted((a, min(4096, len(t) - a)) for t in texts for a in range(0, len(t), 4096))
    for pieces in by_seq.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= 4096


def test_groups_bound_padding_and_ids(spark, empty):
    rng = random.Random(4)
    texts = spark.createDataFrame([(i, " ".join(["ab"] * rng.randint(1, 40)), 5) for i in range(400)], "doc_id int, text string, sequence_id int")
    out = P.pack(P.cut_documents(texts, TOK, capacity=64, keep_ids=True), capacity=64, group_pieces=80).cache()
    assert out.select(F.sum("length")).first()[0] == out.select(F.sum(F.size("ids"))).first()[0]
    per = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert per.agg(F.max("n")).first()[0] <= 64 and per.agg(F.avg("n")).first()[0] > 0.9 * 64
    assert P.pack(P.cut_documents(empty, TOK)).count() == 0
