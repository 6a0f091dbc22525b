import hashlib
import random
import re
import zlib

import numpy as np

from dualspace.llm import periodic_runs as R


def brute_runs(w, least):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least, 2 * q) and not any(all(w[i + k] == w[i + k + p] for k in range(n - p)) for p in range(1, q)):
                out.add((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w, 12)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_equal_brute_force():
    rng = random.Random(4)
    for _ in range(600):
        n, k = rng.randint(0, 50), rng.choice([1, 2, 2, 3, 6])
        w = [b"%d" % rng.randrange(k) for _ in range(n)]
        if n > 4 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        for least in (2, 5, 12):
            assert [tuple(r) for r in R.word_runs(w, least).tolist()] == brute_runs(w, least), (w, least)
        assert [tuple(r) for r in R.runs_of([int(x) + 1 for x in w], 2).tolist()] == brute_runs(w, 2)


def test_tree_answers_common_extensions():
    rng = random.Random(2)
    for k in (1, 2, 5):
        s = [rng.randint(1, k) for _ in range(120)]
        tree = R.SuffixTree(s)
        assert np.argsort(tree.rank).tolist() == sorted(range(121), key=lambda i: s[i:])
        i, j = np.array([(a, b) for a in range(120) for b in range(120) if a != b]).T
        want = [next((x for x in range(120) if max(a, b) + x >= 120 or s[a + x] != s[b + x]), 0) for a, b in zip(i, j)]
        assert tree.extension(i, j).tolist() == want


def test_query_equals_brute_force(spark, docs, corpus, tmp_path):
    rng, rows = random.Random(3), [(r[0], r[1]) for r in corpus if r[1] is None or len(r[1]) < 9000]
    for i in range(300, 420):
        line = ["u%d" % rng.randrange(4) for _ in range(rng.randint(1, 9))]
        rows.append((i, " ".join((line * rng.randint(1, 7) + ["v%d" % rng.randrange(9) for _ in range(rng.randint(0, 9))]) * rng.randint(1, 3))))
    rows += [(None, "a b " * 9), (None, None), (7000, "x " * 40), (7000, "x " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r[0] is None, r[0], r[6], r[7])
    assert sorted((tuple(r) for r in R.query(spark, str(tmp_path)).collect()), key=key) == sorted((brute_row(*r) for r in rows), key=key)


def test_defined_cases(spark, empty):
    assert R.periodic_runs(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c " * 8000, 1, 2)], "doc_id long, text string, start int, period int")
    r = R.periodic_runs(df).first()
    assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (1, 0, 24000, 3, 8000000)
    assert r["collapsed_sha256"] == hashlib.sha256(b"a b c").hexdigest()
