import random
import re

import xxhash

from dualspace.llm import simhash as H


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(rows, bits=4):
    fps = [(i, brute_fp(t)) for i, t in rows]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(fps):
        least[find(x)] = min(i, least.get(find(x), i))
    return sorted((i, f"{f:016x}", least[find(x)]) for x, (i, f) in enumerate(fps))


def test_query_equals_brute_force(spark, docs, corpus, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in H.query(spark, str(tmp_path)).collect())
    want = brute_components([(r[0], r[1]) for r in corpus])
    assert got == want
    assert any(i != c for i, _, c in want) and len({c for _, _, c in want}) > 20


def test_multi_index_hashing_finds_all_links_whatever_the_blocks(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(60)}
    chain = rng.getrandbits(64)
    for _ in range(60):  # chains of exactly four bits, and one crowded ball
        for b in rng.sample(range(64), 4):
            chain ^= 1 << b
        fps.add(chain)
        fps.add(chain ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    ball = rng.getrandbits(64)
    fps |= {ball ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(22) for _ in range(150)} | {0, (1 << 64) - 1, 1 << 63}
    fps = sorted(fps)
    signed = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")

    def labels(pairs):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for f in fps:
            groups.setdefault(find(f), set()).add(f)
        return sorted(map(sorted, groups.values()))
    want = labels([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    for segments, block in ((3, 2048), (3, 16), (2, 64), (5, 8), (4, 32)):
        links = [(a % (1 << 64), b % (1 << 64)) for a, b in H.near_links(signed, segments, 4, block).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in links)
        assert labels(links) == want, (segments, block)


def test_defined_cases(spark, empty):
    assert H.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e", 1), (None, None, 2), (7, "", 3)], "doc_id long, text string, fp int")
    out = {(r["doc_id"], r["fp"] == 0): r["component_id"] for r in H.near_duplicates(rows).collect()}
    assert out == {(None, False): None, (None, True): 7, (7, True): 7}
