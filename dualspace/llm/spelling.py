"""Spelling variants by k-d trees over letter-count vectors.

Two words one edit apart have letter counts at L1 distance at most two: a replaced letter takes one
count down and another up, an inserted letter takes one up. So a word of length n looks for
its neighbours in three k-d trees, those of lengths n - 1, n and n + 1: a box is left as soon as a query would have to
gain or lose more letters than the length pair allows to get into it. In the leaves the
distances are taken, and the words that pass are held letter by letter against the query.

The upper levels of each length's tree are cut on the driver from a bounded sample (SAMPLE words; the cuts only, no
row depends on it) and split the words into cells; a word is a point in its own cell and a query
in every cell that its box searches reach. Each cell is one task's group, which grows the tree on
down to LEAF words. A cell with more than twice CELL points is dealt out by hash, its queries go to each part. A
cell passes on one row per query: the number of near words and the most frequent of them.

Scale: text is reduced to (word, count) inside the tasks and by map-side sums, so the work after that grows
with the vocabulary; a query reaches at most 1 + k + k(k-1)/2 cells of a tree of k levels, as an edit crosses at most two cuts.

Defined cases: a null text has no words; texts of any length are read whole; repeated rows count again; words of
a null doc_id lose no letter; equal counts go to the smaller word in code-point order; other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dualspace.llm.common import written

MIN_LETTERS = 7
MIN_COUNT = 2
FORM_RATIO = 10
DELETE_EVERY = 31
CELL = 16_384
SAMPLE = 50_000
LEAF = 48
WORDS_AT_ONCE = 300_000  # distinct words a task sums up before it passes them on
_FIRST = 0x61  # letters are the Latin-1 codes from here on


def words_of(text: str, doc_id, min_letters: int = MIN_LETTERS, delete_every: int = DELETE_EVERY) -> dict[bytes, int]:
    """Words (Latin-1 bytes) of a text and their counts, some with the letter that a hash of id and word names deleted."""
    from collections import Counter
    runs = Counter(re.findall(rb"[a-z\xc0-\xff]{%d,}" % min_letters, text.encode("latin-1", "replace").lower()))  # bytes: A-Z only
    if doc_id is None:
        return runs
    start, out = zlib.crc32(b"%s:" % str(doc_id).encode()), Counter()
    for w, n in runs.items():
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
        if h % delete_every == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1:]
            if len(w) < min_letters:
                continue
        out[w] += n
    return out


def _count_kernel(min_letters: int, delete_every: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(total):
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()),
                                               pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total: dict[bytes, int] = {}
        for rb in batches:
            for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                for w, n in words_of(text or "", doc_id, min_letters, delete_every).items():
                    total[w] = total.get(w, 0) + n
                if len(total) >= WORDS_AT_ONCE:
                    yield rows(total)
                    total = {}
        yield rows(total)
    return run


def vocabulary(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, delete_every: int = DELETE_EVERY,
               key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words of at least `min_letters` letters and `min_count` occurrences."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    counts = rows.mapInArrow(_count_kernel(min_letters, delete_every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ------------------------------------------------------------------ the tree
def letters(words: list[bytes]):
    """Matrix of letter codes, one word a row; all words have one length."""
    import numpy as np
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def letter_counts(codes):
    """Letter-count vectors of the rows of a code matrix."""
    import numpy as np
    m, width = len(codes), 256 - _FIRST
    flat = (np.arange(m)[:, None] * width + (codes.astype(np.int64) - _FIRST)).ravel()
    return np.bincount(flat, minlength=m * width).reshape(m, width).astype(np.int16)


def grow(x, rows, leaf: float):
    """K-d tree over the vectors x[rows]: (dimension, cut, lower side, upper side) or an array of rows.
    Cuts lie near the median of the dimension of greatest variance."""
    import numpy as np
    if len(rows) <= leaf:
        return rows
    part = x[rows]
    dim = int(part.var(axis=0).argmax())
    v = part[:, dim]
    cut = int(np.median(v))
    if cut == v.max():
        cut -= 1
    lower = v <= cut
    if cut < v.min():  # all vectors are equal
        return rows
    return dim, cut, grow(x, rows[lower], leaf), grow(x, rows[~lower], leaf)


def search(tree, q, rows, gain: int, lose: int) -> Iterator:
    """(leaf, rows) of the queries q[rows] that reach a leaf's box by gaining at most `gain` and losing at most `lose` letters."""
    import numpy as np
    zero = np.zeros(len(rows), np.int16)
    todo = [(tree, rows, zero, zero, {})]  # gains and losses so far, bounds of the box by dimension
    while todo:
        node, at, up, down, box = todo.pop()
        if not len(at):
            continue
        if not isinstance(node, tuple):
            yield node, at
            continue
        dim, cut, lower, upper = node
        v, (lo, hi) = q[at, dim], box.get(dim, (-1 << 14, 1 << 14))
        lost = down + np.maximum(v - cut, 0) - np.maximum(v - hi, 0)
        won = up + np.maximum(cut + 1 - v, 0) - np.maximum(lo - v, 0)
        a, b = lost <= lose, won <= gain
        todo.append((lower, at[a], up[a], lost[a], {**box, dim: (lo, min(cut, hi))}))
        todo.append((upper, at[b], won[b], down[b], {**box, dim: (max(cut + 1, lo), hi)}))


def one_edit(a, b):
    """Row by row of two code matrices, b as wide as a or one wider: is it exactly one replaced or inserted letter?"""
    import numpy as np
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.cumprod(a == b[:, :-1], axis=1, dtype=np.uint8).sum(axis=1)
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1)
    return head.astype(np.int64) + tail >= a.shape[1]


def near_pairs(points, queries, grown=None, leaf: int = LEAF):
    """Positions (query, point) of all pairs one edit apart; code matrices whose widths differ by one at most."""
    import numpy as np
    if not len(points) or not len(queries):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wider = points.shape[1] - queries.shape[1]
    x, q = letter_counts(points), letter_counts(queries)
    tree = grow(x, np.arange(len(x)), leaf) if grown is None else grown
    used = np.flatnonzero(x.any(axis=0) | q.any(axis=0))
    xf, qf = x[:, used].astype(np.float32), q[:, used].astype(np.float32)
    xx, qq = (xf ** 2).sum(axis=1), (qf ** 2).sum(axis=1)
    out = []
    for at, rows in search(tree, q, np.arange(len(q)), int(wider >= 0), int(wider <= 0)):
        # whole numbers; with these lengths L1 distance <= 2 (1) is squared distance 2 (1)
        d = qq[rows, None] + xx[at] - 2.0 * (qf[rows] @ xf[at].T)
        i, j = np.nonzero(d == (1.0 if wider else 2.0))
        if len(i):
            i, j = rows[i], at[j]
            a, b = (queries[i], points[j]) if wider >= 0 else (points[j], queries[i])
            ok = one_edit(a, b)
            out.append((i[ok], j[ok]))
    return tuple(np.concatenate(s) for s in zip(*out)) if out else (np.empty(0, np.int64),) * 2


# ------------------------------------------------------------------ cells
def _numbered(tree, numbers):
    return (*tree[:2], _numbered(tree[2], numbers), _numbered(tree[3], numbers)) if isinstance(tree, tuple) else next(numbers)


def cell_trees(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> dict:
    """{length: tree whose leaves are cell numbers}, cut so that a cell holds about `cell` words; from at most `sample` words."""
    import numpy as np
    from itertools import count
    total = words.count()
    rows = words.select("word").orderBy(F.xxhash64("word"), "word").limit(sample).collect()  # bounded
    each = max(1.0, cell * len(rows) / max(total, 1))
    by_length: dict[int, list[bytes]] = {}
    for r in rows:
        by_length.setdefault(len(r["word"]), []).append(r["word"].encode("latin-1"))
    return {n: _numbered(grow(letter_counts(letters(w)), np.arange(len(w)), each), count()) for n, w in by_length.items()}


def _route_kernel(trees: dict):
    """(len, cell, point, word, n): the word as a point of its cell, and as a query of all cells that it reaches."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for rb in batches:
            word, n = rb.column(0).to_pylist(), rb.column(1).to_numpy()
            size = np.array([len(w) for w in word], np.int64)
            raw = [w.encode("latin-1") for w in word]
            for length in np.unique(size).tolist():
                at = np.flatnonzero(size == length)
                q = letter_counts(letters([raw[i] for i in at]))
                for wide in (-1, 0, 1):
                    tree = trees.get(length + wide, 0)
                    hits = search(tree, q, np.arange(len(q)), int(wide >= 0), int(wide <= 0)) if isinstance(tree, tuple) else [(0, np.arange(len(q)))]
                    own = search(tree, q, np.arange(len(q)), 0, 0) if wide == 0 and isinstance(tree, tuple) else [(0, np.arange(len(q)))] * (wide == 0)
                    for point, found in ((False, hits), (True, own)):
                        for cell, rows in found:
                            rows = at[rows]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(rows), length + wide, np.int32)), pa.array(np.full(len(rows), cell, np.int32)),
                                 pa.array(np.full(len(rows), point)), pa.array([word[i] for i in rows], pa.string()), pa.array(n[rows])],
                                names=["len", "cell", "point", "word", "n"])
    return run


def _cell_kernel(key, group):
    """(word, near, form, form_n) of the queries of one cell that have a near word in it."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    points, queries = group.filter(group.column("point")), group.filter(pc.invert(group.column("point")))
    found = {"word": [], "near": [], "form": [], "form_n": []}
    raw = [w.encode("latin-1") for w in points.column("word").to_pylist()]
    if raw and queries.num_rows:
        n = points.column("n").to_numpy()
        x = letters(raw)
        order = np.lexsort((np.array(raw), -n))  # most frequent first, then by code points
        best = np.empty(len(raw), np.int64)
        best[order] = np.arange(len(raw))
        tree = grow(letter_counts(x), np.arange(len(x)), LEAF)
        word = [w.encode("latin-1") for w in queries.column("word").to_pylist()]
        size = np.array([len(w) for w in word])
        for length in np.unique(size).tolist():
            at = np.flatnonzero(size == length)
            i, j = near_pairs(x, letters([word[k] for k in at]), tree)
            near = np.bincount(i, minlength=len(at))
            top = np.full(len(at), len(raw), np.int64)
            np.minimum.at(top, i, best[j])
            for k in np.flatnonzero(near).tolist():
                p = int(order[top[k]])
                found["word"].append(word[at[k]].decode("latin-1"))
                found["near"].append(int(near[k]))
                found["form"].append(raw[p].decode("latin-1"))
                found["form_n"].append(int(n[p]))
    return pa.table({"word": pa.array(found["word"], pa.string()), "near": pa.array(found["near"], pa.int64()),
                     "form": pa.array(found["form"], pa.string()), "form_n": pa.array(found["form_n"], pa.int64())})


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """words(word, n) -> (word, n_near, form, form_n) of all words with a near word; form is the near word of
    greatest n (ties: the smallest)."""
    routed = written(words.select("word", "n").mapInArrow(_route_kernel(cell_trees(words, cell, sample)),
                                                          "len int, cell int, point boolean, word string, n long"), "routed-words")
    parts = written(routed.where("point").groupBy("len", "cell").agg(F.ceil(F.count(F.lit(1)) / (2 * cell)).cast("int").alias("parts")), "cell-parts")
    rows = routed.join(parts, ["len", "cell"])  # a cell without points has nothing near
    part = F.when(F.col("point"), F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.select("len", "cell", F.explode(part).alias("part"), "point", "word", "n")
    found = rows.groupBy("len", "cell", "part").applyInArrow(_cell_kernel, "word string, near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("rank"), F.col("form").alias("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select(
        "word", "n_near", "best.form", (-F.col("best.rank")).alias("form_n"))


def variants(words: DataFrame, ratio: int = FORM_RATIO, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """words(word, n) -> (word, form, root, n, n_near, form_n). A word's form is the most frequent of its near
    words if that is at least `ratio` (2 or more) times as frequent; root is where the chain of forms ends."""
    if ratio < 2:
        raise ValueError("ratio is 2 or more")
    near = words.join(near_words(words, cell, sample), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n")
    has = F.col("form_n") >= ratio * F.col("n")
    near = written(near.withColumn("form", F.when(has, F.col("form"))).withColumn("form_n", F.when(has, F.col("form_n"))), "forms")
    hop = near.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps taken; counts grow by `ratio` per step, so rounds are few
        after = hop.select(F.col("word").alias("root"), F.col("root").alias("next"))
        hop = written(hop.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")), "roots")
        if not hop.where("more").limit(1).count():
            break
        hop = hop.drop("more")
    return near.join(hop.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the variants among the words of all documents."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return variants(written(vocabulary(docs), "vocabulary"))
