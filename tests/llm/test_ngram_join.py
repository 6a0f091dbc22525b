import random
import re

import numpy as np
import pytest

from dualspace.llm import ngram_join as J


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        r = find(x)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    key = lambda r: tuple((v is None, v) for v in r)
    return sorted(((i, len(sets[x]), least[find(x)]) for x, (i, _) in enumerate(rows)), key=key)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, v) for v in r))


def edited(rng, words, share):
    return [w if rng.random() > share else "z%d" % rng.randrange(10 ** 6) for w in words]


@pytest.fixture(scope="module")
def near(spark):
    """Chains of near copies, passages that many texts share, sets at the very threshold."""
    rng, rows = random.Random(8), []
    passage = ["p%d" % i for i in range(60)]
    for g in range(12):
        base = ["w%d" % rng.randrange(3000) for _ in range(rng.choice([5, 30, 90, 200, 400]))]
        for k in range(14):
            w = edited(rng, base, rng.choice([0, 0.003, 0.01, 0.02, 0.04]))
            rows.append((" ".join(passage + w if g % 3 == 0 else w)))
            base = w if k % 2 else base
    for n in (23, 40, 60):  # 100 * overlap = 85 * union, and just below
        base = ["t%d" % i for i in range(n)]
        rows += [" ".join(base), " ".join(base[:-3]), " ".join(base[:-4]), " ".join(base[2:])]
    rows += [" ".join(passage + ["q%d" % rng.randrange(10 ** 6) for _ in range(8)]) for _ in range(90)]
    rows = [(i, t) for i, t in enumerate(rows)]
    rng.shuffle(rows)
    return rows


def test_join_equals_brute_force_whatever_the_blocks(spark, near):
    df = spark.createDataFrame(near, "doc_id long, text string").repartition(6)
    for percent, block, buckets in ((85, 512, 1 << 18), (85, 6, 1 << 13), (60, 512, 1 << 10), (100, 512, 1 << 18)):
        assert got(J.jaccard_classes(df, percent, block=block, buckets=buckets)) == brute(near, percent), (percent, block)


def test_query_equals_brute_force(spark, docs, corpus, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert got(J.query(spark, str(tmp_path))) == brute([(r[0], r[1]) for r in corpus])


def test_defined_cases(spark, empty):
    assert J.jaccard_classes(empty).count() == 0
    rows = [(None, "A b C d", "x"), (5, "a b c d", "y"), (3, None, "z"), (2, " \n", "z"), (9, "a b", "z"), (8, "A B", "z"), (None, "", "z"), (None, "k l m n o", "q"),
            (5, "a b c d", "y"), (11, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, a string").withColumnsRenamed({}).selectExpr("*", "1 as n", "2 as tok", "3 as root")
    assert got(J.jaccard_classes(df)) == brute([(r[0], r[1]) for r in rows])


def test_tree_prunes_and_finds_all(spark):
    rng = random.Random(1)
    base = [sorted(rng.sample(range(3000), 150)) for _ in range(6)]
    sets = [np.array(sorted(set(b) - set(rng.sample(b, rng.randrange(30))) | set(rng.sample(range(3000), rng.randrange(12))))) for b in base for _ in range(20)]
    tree = J.PrefixTree(sets)
    for x in range(0, len(sets), 7):
        want = [y for y in range(len(sets)) if 100 * len(np.intersect1d(sets[x], sets[y])) >= 85 * len(np.union1d(sets[x], sets[y]))]
        assert sorted(tree.similar(sets[x], 85)) == want
    walked = []
    mask = tree.mask

    class Counting:
        def __getitem__(self, i):
            walked.append(len(i))
            return mask[i]

        def __setitem__(self, i, v):
            mask[i] = v
    tree.mask = Counting()
    tree.similar(sets[0], 85)
    assert sum(walked) < sum(map(len, sets))  # paths are shared, subtrees left
    for y in range(1, len(sets)):
        tree.take_out(y)
    assert tree.similar(sets[0], 85) == [0]


def test_parity_bits_never_lose_a_similar_pair():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 10)), dtype=np.uint64)]))
        if not len(b) or 100 * len(np.intersect1d(a, b)) < 85 * len(np.union1d(a, b)):
            continue
        sets = [a, b]
        bits = [np.frombuffer(J.parity_bits(s), "<u8") for s in sets]
        level = np.array([(len(x) * 8).bit_length() - 4 for x in bits])
        rows = {int(v): (np.where(level == v, np.cumsum(level == v) - 1, 0), np.stack([bits[k] for k in (0, 1) if level[k] == v])) for v in set(level.tolist())}
        assert J._may_be_similar(np.array([0]), np.array([1]), np.array([len(a), len(b)]), level, rows, 85)[0]


def test_a_shingle_of_many_unlike_sets_carries_no_whole_sets(spark, monkeypatch):
    rng, rows = random.Random(4), []
    passage = ["p%d" % i for i in range(30)]
    for k in range(80):
        w = passage + ["w%d" % rng.randrange(10 ** 6) for _ in range(rng.choice([60, 70, 200]))]
        rows += [" ".join(w)] if k % 20 else [" ".join(w), " ".join(w + ["more"]), " ".join(["less"] + w)]
    rows = list(enumerate(rows))
    df, counts, write = spark.createDataFrame(rows, "doc_id long, text string"), {}, J.written

    def counted(frame, name):
        table = write(frame, name)
        counts[name] = table.count()
        return table
    monkeypatch.setattr(J, "written", counted)
    for judged in (J.JUDGED, 3):  # whole bands, a grid in each
        assert got(J.jaccard_classes(df, block=8, buckets=64, judged=judged)) == brute(rows)
        assert counts["frequent"] > 80 and counts["sets"] <= 12  # the near copies only
