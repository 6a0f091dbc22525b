"""Periodic runs of words by suffix trees.

A run is a maximal stretch of consecutive words with smallest period q and at least two
periods. Every run holds a Lyndon root: for the letter order or for its reverse, the
longest Lyndon word that starts at some place of the run is one period long. So
each place gives at most two candidates, and each candidate is extended to the right and to the left by its
longest common extensions (LCE). Those are the string depths of lowest common ancestors in
the suffix tree of the stretch and in that of its reversal, both built by Ukkonen's algorithm; an
Euler tour turns an ancestor query into a range minimum over the depths between two leaves, and a sparse table answers it
in constant time, for all candidates at once.

Trees are built only where a run can lie. A run of at least MIN_LENGTH words and of two periods holds
every word of it in a gram of MIN_LENGTH / 2 words that occurs twice inside the run. The text is cut at words that no such
repeated gram covers, and each piece again, until nothing changes; what is left of ordinary prose is little.

Scale: one pass over the rows, no shuffle; memory is that of one text and its trees.

Defined cases: a null text is empty and has no runs; texts of any length are used whole; repeated rows give
repeated result rows; a null doc_id is kept (nothing is planted in its text); other columns are ignored; of
runs of equal length the first counts as the longest, then the shorter period. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_LENGTH = 12


class SuffixTree:
    """Ukkonen's suffix tree of integers >= 1, closed by a 0 that sorts first.

    `rank[i]` is the place of suffix i among all suffixes, `extension(i, j)` the
    length of the longest common prefix of suffixes i and j (arrays, i != j)."""

    def __init__(self, letters: list[int]):
        self._text = [*letters, 0]
        self._grow()
        self._tour()

    def _grow(self) -> None:
        text = self._text
        n = len(text)
        # nodes: edge text[start:stop] into the node, children by first letter, suffix link
        start, stop, down, link = [0], [0], [{}], [0]
        node = at = length = waiting = 0  # active point: `length` letters from text[at] below `node`
        for i in range(n):
            letter = text[i]
            waiting += 1
            fresh = 0  # inner node of this phase that still lacks its suffix link
            while waiting:
                if not length:
                    at = i
                child = down[node].get(text[at])
                if child is None:
                    down[node][text[at]] = len(start)
                    start.append(i)
                    stop.append(n)
                    down.append(None)
                    link.append(0)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    edge = (stop[child] if stop[child] < i + 1 else i + 1) - start[child]
                    if length >= edge:
                        at += edge
                        length -= edge
                        node = child
                        continue
                    if text[start[child] + length] == letter:
                        if fresh:
                            link[fresh] = node
                        length += 1
                        break
                    split = len(start)
                    start.append(start[child])
                    stop.append(start[child] + length)
                    down.append({letter: split + 1, text[start[child] + length]: child})
                    link.append(0)
                    start.append(i)
                    stop.append(n)
                    down.append(None)
                    link.append(0)
                    down[node][text[at]] = split
                    start[child] += length
                    if fresh:
                        link[fresh] = split
                    fresh = split
                waiting -= 1
                if node == 0 and length:
                    length -= 1
                    at = i - waiting + 1
                elif node:
                    node = link[node]
        self._start, self._stop, self._down = start, stop, down

    def _tour(self) -> None:
        """Euler tour in letter order: leaves in the order of their suffixes, and the least
        string depth that the tour passes between two neighbouring leaves."""
        import numpy as np
        n, start, stop, down = len(self._text), self._start, self._stop, self._down
        order, between, low = [], [], 0
        todo = [(0, 0, None)]
        while todo:
            node, depth, rest = todo.pop()
            if down[node] is None:
                order.append(n - depth)
                between.append(low)
                low = depth
                continue
            if depth < low:
                low = depth
            if rest is None:
                kids = down[node]
                rest = [kids[x] for x in sorted(kids, reverse=True)]
            child = rest.pop()
            if rest:
                todo.append((node, depth, rest))
            todo.append((child, depth + stop[child] - start[child], None))
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        table = [np.array(between, np.int32)]
        while 2 << (len(table) - 1) <= n:
            half, last = 1 << (len(table) - 1), table[-1]
            table.append(np.minimum(last[:-half], last[half:]))
        self._least = table
        self._start = self._stop = self._down = None

    def extension(self, i, j):
        import numpy as np
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1  # minimum over lo <= x < hi
        level = np.log2(hi - lo).astype(np.int64)
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self._least[k][lo[m]], self._least[k][hi[m] - (1 << int(k))])
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one whose rank is smaller (the end where there is none)."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(letters: list[int], min_length: int = MIN_LENGTH):
    """(k, 3) array of (start, length, period) of all runs of at least `min_length`, by start, then period."""
    import numpy as np
    n = len(letters)
    if n < 2:
        return np.empty((0, 3), np.int64)
    forward, backward = SuffixTree(letters), SuffixTree(letters[::-1])
    rank, places = forward.rank[:n], np.arange(n)
    # longest Lyndon words: up to the next smaller suffix, for the letter order and its reverse
    ends = np.concatenate([_next_smaller(rank.tolist()), _next_smaller((-rank).tolist())])
    i, period = np.concatenate([places, places]), None
    inside = ends < n
    i, j = i[inside], ends[inside]
    if not len(i):
        return np.empty((0, 3), np.int64)
    period = j - i
    right = forward.extension(i, j)
    left = np.zeros(len(i), np.int64)
    more = i > 0
    left[more] = backward.extension(n - i[more], n - j[more])
    length = left + period + right
    good = length >= np.maximum(2 * period, min_length)
    found = np.stack([i - left, length, period], axis=1)[good]
    return np.unique(found[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]] if len(found) else found


def _stretches(ids, gram: int):
    """(start, stop) of the pieces all of whose words lie in a gram that occurs twice in the piece."""
    import numpy as np
    n = len(ids)
    if n < 2 * gram:
        return []
    u = np.uint64
    g = ids[:n - gram + 1].astype(np.uint64)
    for k in range(1, gram):
        g = (g ^ (g >> u(29))) * u(0xBF58476D1CE4E5B9) + ids[k:n - gram + 1 + k].astype(np.uint64)
    at, piece = np.arange(len(g)), np.zeros(n, np.int64)
    while True:
        key = np.lexsort((g[at], piece[at]))  # only grams that lie in one piece are left
        s = at[key]
        same = (g[s[1:]] == g[s[:-1]]) & (piece[s[1:]] == piece[s[:-1]])
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        kept = np.sort(s[twice])
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, kept, 1)
        np.add.at(cover, kept + gram, -1)
        covered = np.cumsum(cover[:n]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
        bounds = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        if len(kept) == len(at) or not bounds:
            return [b for b in bounds if b[1] - b[0] >= 2 * gram]
        piece = np.cumsum(np.concatenate(([0], (np.diff(covered.astype(np.int8)) != 0).astype(np.int64))))
        at = kept[piece[kept] == piece[kept + gram - 1]]


def word_runs(words: list, min_length: int = MIN_LENGTH):
    """(k, 3) array of (start, length, period) of all runs of a list of words, by start, then period."""
    import numpy as np
    from xxhash import xxh3_64_intdigest
    n = len(words)
    if n < max(min_length, 2):
        return np.empty((0, 3), np.int64)
    ids = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    out = []
    for lo, hi in _stretches(ids, max(1, min_length // 2)):
        letters: dict = {}
        found = runs_of([letters.setdefault(w, len(letters) + 1) for w in words[lo:hi]], min_length)
        out.append(found + np.array([lo, 0, 0]))
    return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def collapsed(words: list, runs) -> list:
    """The words without those that some run holds after its first period."""
    import numpy as np
    if not len(runs):
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(drop) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def planted(words: list, doc_id) -> list:
    """The words of a text as the query reads them: in a tenth of the documents, by a hash of the
    id, everything after a place is a repetition of the words that follow it."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[:n - a]


_SCHEMA = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
           "collapsed_sha256 string")


def _kernel(read, min_length: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for rb in batches:
            ids, out = rb.column(0), []
            for doc_id, text in zip(ids.to_pylist(), rb.column(1).to_pylist()):
                words = read(text.split(), doc_id)  # bytes: split at exactly the six ASCII white-space bytes
                runs = word_runs(words, min_length)
                best = [None] * 4
                if len(runs):
                    s, length, p = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
                    best = [s, length, p, 1000 * length // p]
                lines = "".join("%d,%d,%d\n" % tuple(r) for r in runs.tolist())
                out.append([len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(),
                            hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()])
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]],
                                             names=["doc_id", *[c.split()[0] for c in _SCHEMA.split(", ")]])
    return run


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, key: str = "doc_id", text: str = "text", read=lambda words, doc_id: words) -> DataFrame:
    """Per row of `docs`: doc_id, the number of runs, the longest one, digests of the list of all runs
    and of the text without repetitions. `read(words, doc_id)` may change the words first."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    return rows.mapInArrow(_kernel(read, min_length), f"doc_id {dict(rows.dtypes)['doc_id']}, {_SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the runs of every document, with repetitions planted in a tenth of them."""
    return periodic_runs(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), read=planted)
