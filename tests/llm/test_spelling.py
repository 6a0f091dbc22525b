import random
import re
import zlib
from collections import Counter

import numpy as np

from dualspace.llm import spelling as S


def brute_vocabulary(rows):
    out = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words):
    out = []
    near = {w: [x for x in words if distance_one(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]]))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def misspelled(rng, w):
    i, c = rng.randrange(len(w)), rng.choice("abcdeé")
    return rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:], "".join(rng.sample(w, len(w)))])


def test_variants_equal_brute_force_whatever_the_cells(spark):
    rng = random.Random(6)
    words = {}
    for _ in range(150):
        w = "".join(rng.choices("abcde", k=rng.randint(7, 9)))
        words[w] = 5000
        for n in (400, 40, 30, 2):  # chains of forms, ties
            w = misspelled(rng, w)
            words.setdefault(w, n) if len(w) >= 7 else None
    words |= {"aaaaaaa": 1000, "aaaaaab": 1000, "aaaaaac": 3, "ccccccccccccccccccccccc": 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    want = brute_variants(words)
    for cell, sample in ((16384, 50000), (10, 300), (5, 20), (40, 1)):
        assert rows_of(S.variants(df, cell=cell, sample=sample)) == want, (cell, sample)
    assert any(r[1] and r[2] != r[1] for r in want)


def test_query_equals_brute_force(spark, corpus, tmp_path):
    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdeà", k=rng.randint(6, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocab).upper() if rng.random() < 0.1 else misspelled(rng, rng.choice(vocab)) if rng.random() < 0.1 else
                         rng.choice(vocab[:1 + rng.randrange(60)]) for _ in range(80))) for i in range(40)]
    rows += [(r[0], r[1]) for r in corpus[:20]] + [(None, "ÀBCDEFGH àbcdefghłabcdefgh×÷"), (None, None), (3, ""), (50, "Ğabcdefgh日本abcdefgi"), (50, "abcdefgi")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(S.query(spark, str(tmp_path))) == brute_variants(brute_vocabulary(rows))


def test_boxes_prune_and_lose_nothing():
    rng = np.random.default_rng(3)
    codes = rng.integers(0x61, 0x6B, (3000, 8)).astype(np.uint8)
    codes = np.unique(codes, axis=0)
    q = codes[:100].copy()
    q[np.arange(100), rng.integers(0, 8, 100)] = 0x61
    i, j = S.near_pairs(codes, q)
    want = {(a, b) for a in range(100) for b in np.flatnonzero((codes != q[a]).sum(axis=1) == 1).tolist()}
    assert set(zip(i.tolist(), j.tolist())) == want
    tree = S.grow(S.letter_counts(codes), np.arange(len(codes)), S.LEAF)
    looked = sum(len(at) * len(rows) for at, rows in S.search(tree, S.letter_counts(q), np.arange(100), 1, 1))
    assert looked < 100 * len(codes) / 2


def test_defined_cases(spark, empty):
    assert S.variants(S.vocabulary(empty)).count() == 0
    df = spark.createDataFrame([(1, "zzzzzzz " * 3, "x", 1), (1, "zzzzzzz " * 3, "x", 1)], "doc_id long, text string, word string, n int")
    assert rows_of(S.variants(S.vocabulary(df))) == brute_variants(brute_vocabulary([(1, "zzzzzzz " * 3)] * 2))
