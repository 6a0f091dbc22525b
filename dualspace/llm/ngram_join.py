"""N-gram Jaccard join by prefix trees.

A document's set is that of its distinct 4-word shingles, as hashes whose numeric order
is the global one: rare classes first. A shingle's class is the binary logarithm of how
far the bucket it counts in lies above the mean bucket, from one count table over all
documents. Two sets of similarity t or more share one of their first
n - ceil(t n) + 1 shingles, so only these prefixes are shuffled, one row per
shingle and set. One exchange drops the shingles of a single set; those above class 0, which may be
frequent, pass it unjudged, each row on its own, so that no task gathers them.

Sets that share a prefix shingle are first held against each other by parity bits, about one bit per shingle
(a shingle flips the bit that its hash names): two sets differ in at least as many shingles as their bits
differ, so an entry without a partner that may be similar goes. So does one whose shared shingle comes too late in both
sets: where it is the first in common, all shingles before it differ. A shingle of more sets than a block is judged
in cells of sets of like size (two neighbouring bands), cut into a grid where they are large; there too only bits travel. Only then do whole sets travel.

They meet in cells, where they are stored in a prefix tree (a radix trie of the ordered sets). A probe walks the
tree once, adding up the overlap along each shared path; a subtree is left as soon as the overlap so far and the
shingles that remain on both sides cannot reach the threshold for any of its sizes. A cell passes on a spanning
forest of its links, never all pairs: sets that are already in one component leave the tree.

Round 1 sends each set to the cells of its first FIRST shared shingles, in chunks with one common
pivot. Round 2 is complete: a shingle needs looking at only if its sets lie in two or more
components and if they do not all have the same shared shingle before it (a pair with one in
common earlier meets there). There the sets outside the largest component meet each other and that
component on a grid of blocks.

Scale: a cell holds at most two blocks of sets. A set is named by 64 bits of its hash while its prefix travels. A shingle of a third of all sets is counted by map-side
sums and joined by a join that Spark may split; equal sets travel as one. The count table has a fixed number
of buckets (`buckets`; raise it with the corpus, as hot shingles stand out from the mean bucket only).

Defined cases: a null text is empty; a text without words has no shingles and component_id is
its own doc_id; fewer words than a shingle's give one shingle, the whole sequence; texts of any length
are used whole; repeated rows give repeated result rows; a null doc_id is kept (component_id is the
smallest non-null one, null if there is none); other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dualspace.llm.common import broadcast_checked, written
from dualspace.llm.components import components

SHINGLE = 4
PERCENT = 85
BUCKETS = 1 << 18
BAND = 1 << 13
FIRST = 2  # shared shingles of a set that round 1 looks at
BLOCK = 512  # sets per block; entries of shingles with more sets than this are judged by bands of size
JUDGED = 2048  # entries per block of a band's cell
#: shingles of more sets than a block are listed to all tasks up to this count, joined by a shuffle beyond
HOT_LIST_ROWS = 20_000
SEEN_SETS = 200_000  # equal sets are collapsed inside a task while it remembers this many
_HASH_BITS = 58


def _mixed(x):
    import numpy as np
    u = np.uint64
    x = (x ^ (x >> u(32))) * u(0xD6E8FEB86659FD93)
    x = (x ^ (x >> u(29))) * u(0xA3B195354A39B70D)
    return x ^ (x >> u(32))


def shingle_set(text: bytes, shingle: int = SHINGLE):
    """Sorted 64-bit hashes of the distinct shingles of a UTF-8 text."""
    import numpy as np
    from xxhash import xxh3_64_intdigest
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space bytes
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - shingle + 1
    s = h[:n]
    for k in range(1, shingle):
        s = _mixed(s) + h[k:k + n]
    return np.unique(_mixed(s))


def _set_id(s) -> tuple[int, int]:
    from xxhash import xxh3_128_intdigest
    d = xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def ordered(s, classes):
    """A set in the global order: class above hash, as one positive number."""
    import numpy as np
    c = classes[(s & np.uint64(len(classes) - 1)).astype(np.int64)].astype(np.int64)
    return np.sort(c << _HASH_BITS | (s >> np.uint64(64 - _HASH_BITS)).astype(np.int64))


def parity_bits(s) -> bytes:
    """Bit k is the parity of the shingles whose hash is k modulo the number of bits, the power of two next to the set's size (64 at least)."""
    import numpy as np
    width = 1 << max(6, round(float(np.log2(len(s)))))
    at = (s >> np.uint64(20) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=width).astype(np.uint8) & 1, bitorder="little").tobytes()


def _profile_kernel(shingle: int, buckets: int):
    """(doc_id, n, a, b, bits) per document, then the task's counts in bands of the count table."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        total, ids = np.zeros(buckets, np.uint64), None
        names = ["doc_id", "n", "a", "b", "bits", "band", "counts"]
        for rb in batches:
            ids, out = rb.column(0), []
            for t in rb.column(1).to_pylist():
                s = shingle_set(t, shingle)
                out.append((len(s), *((*_set_id(s), parity_bits(s)) if len(s) else (None, None, None))))
                at, c = np.unique((s & np.uint64(buckets - 1)).astype(np.int64), return_counts=True)
                total[at] += c.astype(np.uint64)
            cols = [pa.array([r[k] for r in out], pa.int64()) for k in range(3)]
            bits = pa.array([r[3] for r in out], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, *cols, bits, pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.binary())], names=names)
        if ids is not None:
            width = min(BAND, buckets)
            k = buckets // width
            none = [pa.nulls(k, pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([pa.nulls(k, ids.type), *none, pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(
                [total[i * width:(i + 1) * width].tobytes() for i in range(k)], pa.binary())], names=names)
    return run


def _sum_counts(key, table):
    import numpy as np
    import pyarrow as pa
    total = 0
    for c in table.column("counts"):
        total = total + np.frombuffer(c.as_buffer(), np.uint64)
    return pa.table({"band": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def shingle_classes(profile: DataFrame, buckets: int):
    """One class per bucket (a byte each): 0 up to twice the mean count, then one more per doubling."""
    import numpy as np
    rows = profile.where("band is not null").select("band", "counts").groupBy("band").applyInArrow(_sum_counts, "band int, counts binary").collect()
    total = np.zeros(buckets, np.float64)  # `buckets` numbers reach the driver, whatever the corpus
    width = min(BAND, buckets)
    for r in rows:
        total[r["band"] * width:(r["band"] + 1) * width] = np.frombuffer(r["counts"], np.uint64)
    return np.clip(np.log2(np.maximum(total / max(total.mean(), 1.0), 1.0)), 0, 31).astype(np.uint8)


def _prefix_kernel(shingle: int, percent: int, classes):
    """(tok, a, pos) of the first n - ceil(t n) + 1 shingles of each set."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        seen: set = set()
        for rb in batches:
            toks, meta = [np.empty(0, np.int64)], []
            for t in rb.column(0).to_pylist():
                s = shingle_set(t, shingle)
                key = _set_id(s) if len(s) else None
                if key is None or key in seen:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(key)
                k = len(s) - -(-percent * len(s) // 100) + 1
                toks.append(ordered(s, classes)[:k])
                meta.append((key[0], k))
            m = np.array(meta, np.int64).reshape(-1, 2)
            each = m[:, 1]
            pos = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(toks)), pa.array(np.repeat(m[:, 0], each)),
                                              pa.array(pos.astype(np.int32))], names=["tok", "a", "pos"])
    return run


def _whole_kernel(shingle: int, classes, wanted):
    """(a, b, toks) of the sets whose id hits the bit table `wanted` (a superset of those asked for)."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        bits, seen = np.frombuffer(wanted, np.uint8), set()
        for rb in batches:
            out = []
            for t in rb.column(0).to_pylist():
                s = shingle_set(t, shingle)
                if not len(s):
                    continue
                key = _set_id(s)
                at = key[0] & (len(bits) * 8 - 1)
                if key in seen or not bits[at >> 3] >> (at & 7) & 1:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(key)
                out.append((*key, ordered(s, classes)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                                              pa.array([r[2] for r in out], pa.list_(pa.int64()))], names=["a", "b", "toks"])
    return run


def _bit_table(ids: DataFrame, log_bits: int = 22) -> bytes:
    """A fixed table of bits, set where an id's low bits fall: 512 KiB, whatever the number of ids."""
    import numpy as np
    at = F.col("a").bitwiseAND((1 << log_bits) - 1)
    words = ids.select(F.shiftright(at, 5).cast("int").alias("w"), F.expr("shiftleft(1L, int(a & 31))").alias("m"))
    rows = words.groupBy("w").agg(F.bit_or("m").alias("m")).collect()
    table = np.zeros(1 << (log_bits - 5), "<u4")
    for r in rows:
        table[r["w"]] = r["m"]
    return table.tobytes()


def _may_be_similar(i, j, n, level, rows, percent: int):
    """Which pairs (i, j) of sets their sizes and parity bits leave. rows[v]: bits of the sets of level v, as (position of set, matrix)."""
    import numpy as np
    near = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    most = (100 - percent) * (n[i] + n[j]) // (100 + percent)  # shingles that similar sets differ in
    swap = level[i] > level[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    for v in np.unique(level[i[near]]).tolist():
        for up in (0, 1):
            at = np.flatnonzero(near & (level[i] == v) & (level[j] == v + up))
            if not len(at):
                continue
            (mine, a), (theirs, b) = rows[v], rows[v + up]
            b = b if not up else b[:, :b.shape[1] // 2] ^ b[:, b.shape[1] // 2:]  # parities of half as many bits
            step = max(1, (1 << 21) // a.shape[1])
            for lo in range(0, len(at), step):
                x = at[lo:lo + step]
                near[x] = np.bitwise_count(a[mine[i[x]]] ^ b[theirs[j[x]]]).sum(axis=1) <= most[x]
    return near


def _partner_kernel(percent: int, names: list[str], key: str = "tok", pairs_at_once: int = 1 << 20):
    """Rows sorted by `key`, a block or two per key, all of one tok: those with a partner that may be
    similar and may have this shingle as the first in common (not the same one before, not too late in both), as columns `names`."""
    def judged(t):
        import numpy as np
        tok, n, pos = (t.column(c).to_numpy() for c in (key, "n", "pos"))
        before = t.column("prev").fill_null(-1).to_numpy()
        bits = t.column("bits").to_pylist()
        level = np.array([len(x).bit_length() - 4 for x in bits], np.int64)  # 8 bytes: level 0
        rows = {}
        for v in np.unique(level).tolist():
            at = np.flatnonzero(level == v)
            where = np.zeros(len(bits), np.int64)
            where[at] = np.arange(len(at))
            rows[v] = where, np.frombuffer(b"".join(bits[x] for x in at.tolist()), "<u8").reshape(len(at), -1)
        start = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
        size = np.diff(np.append(start, len(tok)))
        after = np.repeat(start + size, size) - np.arange(len(tok)) - 1  # rows of the same tok that follow
        ends, good, lo = np.cumsum(after), np.zeros(len(tok), bool), 0
        while lo < len(tok):
            base = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + pairs_at_once, "right")))
            e = after[lo:hi]
            i = np.repeat(np.arange(lo, hi), e)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(e) - e, e)
            first = ((before[i] != before[j]) | (before[i] < 0)) & ((100 + percent) * (pos[i].astype(np.int64) + pos[j]) <= (100 - percent) * (n[i] + n[j]))
            i, j = i[first], j[first]
            near = _may_be_similar(i, j, n, level, rows, percent)
            good[i[near]] = good[j[near]] = True
            lo = hi
        return t.filter(good).select(names)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        held = None
        for rb in batches:
            t = pa.Table.from_batches([rb])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            if not t.num_rows:
                continue
            tok = t.column(key).to_numpy()
            cut = int(np.searchsorted(tok != tok[-1], False)) if (tok[0] != tok[-1]) else 0  # where the last tok begins
            if cut:
                yield from judged(t.slice(0, cut)).to_batches()
            held = t.slice(cut)
        if held is not None:
            yield from judged(held).to_batches()
    return run


class PrefixTree:
    """Radix trie of distinct ascending integer sets; sets can be taken out."""

    def __init__(self, sets):
        import numpy as np
        keys = [s.astype(">u4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets, self.leaf = sets, [0] * len(sets)
        # per node: depth at its end, a set that runs through it, parent, children, the set that ends here
        self.depth, self.rep, self.parent, self.children, self.ends = [0], [order[0] if order else -1], [-1], [[]], [-1]
        path, before = [0], None
        for i in order:
            s = sets[i]
            common = 0
            if before is not None:
                m = min(len(before), len(s))
                odd = np.flatnonzero(before[:m] != s[:m])
                common = int(odd[0]) if len(odd) else m
            last = -1
            while self.depth[path[-1]] > common:
                last = path.pop()
            if self.depth[path[-1]] < common:
                mid = self._node(common, i, path[-1], -1)
                self.children[path[-1]].remove(last)
                self.children[path[-1]].append(mid)
                self.children[mid].append(last)
                self.parent[last] = mid
                path.append(mid)
            self.leaf[i] = new = self._node(len(s), i, path[-1], i)
            self.children[path[-1]].append(new)
            path.append(new)
            before = s
        n = len(self.depth)
        self.alive, self.least, self.most = [0] * n, [1 << 60] * n, [0] * n
        for i, s in enumerate(sets):
            v = self.leaf[i]
            while v >= 0:
                self.alive[v] += 1
                self.least[v] = min(self.least[v], len(s))
                self.most[v] = max(self.most[v], len(s))
                v = self.parent[v]
        self.mask = np.zeros(1 + max((int(s[-1]) for s in sets), default=0), bool)

    def _node(self, depth, rep, parent, ends):
        self.depth.append(depth)
        self.rep.append(rep)
        self.parent.append(parent)
        self.children.append([])
        self.ends.append(ends)
        return len(self.depth) - 1

    def take_out(self, i: int) -> None:
        v = self.leaf[i]
        self.ends[v] = -1
        while v >= 0:
            self.alive[v] -= 1
            v = self.parent[v]

    def similar(self, x, percent: int) -> list[int]:
        """Sets in the tree whose Jaccard similarity with `x` is at least `percent` / 100."""
        self.mask[x] = True
        found, todo, nx = [], [(0, 0)], len(x)
        while todo:
            v, overlap = todo.pop()
            for c in self.children[v]:
                if not self.alive[c]:
                    continue
                edge = self.sets[self.rep[c]][self.depth[v]:self.depth[c]]
                o = overlap + int(self.mask[edge].sum())
                left = min(nx - int(x.searchsorted(edge[-1], "right")), self.most[c] - self.depth[c])
                if (100 + percent) * (o + left) < percent * (nx + self.least[c]):
                    continue
                y = self.ends[c]
                if y >= 0 and (100 + percent) * o >= percent * (nx + len(self.sets[y])):
                    found.append(y)
                if self.children[c]:
                    todo.append((c, o))
        self.mask[x] = False
        return found


def tree_links(sets, groups, percent: int) -> list[tuple[int, int]]:
    """Links (positions in `sets`) that join the components of the similarity graph on top
    of `groups`, labels of sets that are known to be connected."""
    import numpy as np
    every = np.unique(np.concatenate(sets)) if len(sets) else np.empty(0, np.int64)
    sets = [np.searchsorted(every, s) for s in sets]
    tree, members = PrefixTree(sets), {}
    for i, g in enumerate(groups):
        members.setdefault(g, []).append(i)
    links = []
    for g in sorted(members, key=lambda g: len(members[g])):
        queue = members.pop(g, [])
        for i in queue:
            tree.take_out(i)
        while queue and members:
            x = queue.pop()
            for y in tree.similar(sets[x], percent):
                if groups[y] in members:
                    links.append((x, y))
                    more = members.pop(groups[y])
                    for i in more:
                        tree.take_out(i)
                    queue += more
        if not members:
            break
    return links


def _banded(rows: DataFrame, percent: int, judged: int) -> DataFrame:
    """Rows (tok, a, b, n, ...) of frequent shingles in cells, a number `cell` each: any two of one tok whose sizes may be those of similar sets meet in one."""
    step = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9  # sizes of similar sets lie in one band or two neighbouring ones
    band = F.floor(F.log(F.col("n")) / F.lit(step))
    rows = rows.withColumn("c", F.explode(F.array(band - 1, band)))
    parts = rows.groupBy("tok", "c").agg(F.ceil(F.count(F.lit(1)) / judged).cast("int").alias("parts")).where("parts > 1")
    rows = rows.join(parts, ["tok", "c"], "left")
    pair = lambda i: F.xxhash64("tok", "c", F.least(i, _own("parts")), F.greatest(i, _own("parts")))
    cells = F.when(F.col("parts").isNull(), F.array(F.xxhash64("tok", "c"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), pair))
    return rows.withColumn("cell", F.explode(cells)).drop("c", "parts")


def _cell_kernel(percent: int):
    def run(key, t):
        import numpy as np
        import pyarrow as pa
        node = list(zip(t.column("a").to_pylist(), t.column("b").to_pylist()))
        first = {}
        for i, x in enumerate(node):  # a pivot may come twice
            first.setdefault(x, i)
        rows = sorted(first.values())
        lists = t.column("toks").combine_chunks()
        sets = [lists[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for i in rows]
        group = t.column("root").to_pylist()
        found = tree_links(sets, [group[i] for i in rows], percent)
        a, b = [node[rows[x]] for x, _ in found], [node[rows[y]] for _, y in found]
        return pa.table([pa.array([v[k] for v in side], pa.int64()) for side in (a, b) for k in (0, 1)], names=["a1", "b1", "a2", "b2"])
    return run


def _links(cells: DataFrame, keys: list[str], sets: DataFrame, percent: int) -> DataFrame:
    rows = cells.join(sets, ["a", "b"]).select(*keys, "a", "b", "root", "toks")
    return rows.groupBy(*keys).applyInArrow(_cell_kernel(percent), "a1 long, b1 long, a2 long, b2 long")


def _own(n: str) -> Column:
    return F.pmod(F.xxhash64("a", "b"), F.col(n)).cast("int")


def _first_cells(shared: DataFrame, block: int) -> DataFrame:
    """Round 1: (tok, chunk, a, b, root), every set with its FIRST shared shingles."""
    mine = shared.where(F.col("r") <= FIRST)
    parts = mine.groupBy("tok").agg(F.count(F.lit(1)).alias("m"), F.min("a").alias("pa")).where("m > 1").select(
        "tok", "pa", F.ceil(F.col("m") / block).cast("int").alias("parts"))
    rows = mine.join(parts, "tok")
    chunk = F.when(F.col("a") == F.col("pa"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(_own("parts")))
    return rows.select("tok", F.explode(chunk).alias("chunk"), "a", "b", F.xxhash64("a", "b").alias("root"))


def _rest_cells(shared: DataFrame, block: int) -> DataFrame:
    """Round 2: (tok, big, x, y, a, b, root) of the shingles that may still hold a link. `shared` has `root`."""
    by_root = shared.groupBy("tok", "root").agg(F.count(F.lit(1)).alias("m"), F.count("prev").alias("with"),
                                                F.min("prev").alias("lo"), F.max("prev").alias("hi"))
    per = by_root.groupBy("tok").agg(F.sum("m").alias("m"), F.max("m").alias("most"), F.max_by("root", F.struct("m", "root")).alias("main"), F.count(F.lit(1)).alias("k"),
                                     F.sum("with").alias("with"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    per = per.where("k > 1 and (with < m or lo < hi)").select(
        "tok", "main", F.ceil(F.col("most") / block).cast("int").alias("nd"), F.ceil((F.col("m") - F.col("most")) / block).cast("int").alias("no"))
    rows = shared.select("tok", "a", "b", "root").join(per, "tok")
    cell = lambda big, x, y: F.struct(F.lit(big).alias("big"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    o = _own("no")
    main = F.transform(every("no"), lambda i: cell(True, i, _own("nd")))
    others = F.concat(F.transform(every("nd"), lambda d: cell(True, o, d)),
                      F.when(F.col("no") > 1, F.transform(every("no"), lambda i: cell(False, F.least(i, o), F.greatest(i, o))))
                      .otherwise(F.array().cast("array<struct<big:boolean,x:int,y:int>>")))
    return rows.withColumn("c", F.explode(F.when(F.col("root") == F.col("main"), main).otherwise(others))).select("tok", "c.*", "a", "b", "root")


def jaccard_classes(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, buckets: int = BUCKETS, block: int = BLOCK,
                    key: str = "doc_id", text: str = "text", judged: int = JUDGED) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id reachable over pairs
    whose sets have a Jaccard similarity of at least `percent` / 100 (1 to 100)."""
    if not 1 <= percent <= 100 or buckets & (buckets - 1):
        raise ValueError("percent is 1 to 100 and buckets a power of two")
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    kind = dict(rows.dtypes)["doc_id"]
    profile = written(rows.mapInArrow(_profile_kernel(shingle, buckets), f"doc_id {kind}, n long, a long, b long, bits binary, band int, counts binary"), "profile")
    classes = shingle_classes(profile, buckets)
    marked = profile.where("band is null").select("doc_id", "n", "a", "b", "bits")
    body = rows.select("body")
    entries = body.mapInArrow(_prefix_kernel(shingle, percent, classes), "tok long, a long, pos int")
    frequent = F.col("tok") >= 1 << _HASH_BITS  # above class 0: not held together, not looked at
    together = Window.partitionBy("tok", F.when(frequent, F.col("a")))  # at most twice the mean bucket
    entries = entries.withColumns({"lo": F.min("a").over(together), "hi": F.max("a").over(together)})
    shared = entries.where(frequent | (F.col("lo") < F.col("hi"))).select("tok", "a", "pos").repartition("a").dropDuplicates(["a", "pos"])
    by_set = Window.partitionBy("a").orderBy("pos")  # a set's prefix: bounded by one text
    shared = written(shared.select("tok", "a", "pos", F.lag("tok").over(by_set).alias("prev")), "shared")
    distinct = written(marked.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits")), "distinct-sets")
    names = ["tok", "a", "b", "pos", "prev"]
    hot = broadcast_checked(written(shared.groupBy("tok").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block).select("tok"), "hot-shingles"), HOT_LIST_ROWS)
    few = shared.join(hot, "tok", "left_anti").join(distinct.select("a", "b", "n", "bits"), "a").select(*names, "n", "bits")
    few = few.repartition("tok").sortWithinPartitions("tok").mapInArrow(_partner_kernel(percent, names), "tok long, a long, b long, pos int, prev long")
    many = written(shared.join(hot, "tok", "left_semi").join(distinct.select("a", "b", "n", "bits"), "a").select(*names, "n", "bits"), "frequent")
    many = _banded(many, percent, judged).repartition("cell").sortWithinPartitions("cell").mapInArrow(
        _partner_kernel(percent, names, "cell"), "tok long, a long, b long, pos int, prev long").dropDuplicates(["tok", "a", "b"])
    met = written(few.union(many).withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy("pos"))), "met")
    ids = met.where("r = 1").select("a", "b")
    sets = body.mapInArrow(_whole_kernel(shingle, classes, _bit_table(ids)), "a long, b long, toks array<long>")
    sets = written(sets.join(ids, ["a", "b"], "left_semi").dropDuplicates(["a", "b"]), "sets")

    # nodes of the graph: sets in the order of their smallest doc_id, so that a component's root names it
    firsts = distinct.select("a", "b", "doc_id")
    node = lambda a, b, d: F.struct(F.col(d).isNull().alias("no_id"), F.col(d).alias("doc_id"), F.col(a).alias("a"), F.col(b).alias("b"))
    named = firsts.select("a", "b", node("a", "b", "doc_id").alias("node")).join(ids, ["a", "b"], "left_semi")
    named = written(named, "nodes")

    def edges(links: DataFrame) -> DataFrame:
        one = named.select(F.col("a").alias("a1"), F.col("b").alias("b1"), F.col("node").alias("u"))
        two = named.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("node").alias("v"))
        return written(links.join(one, ["a1", "b1"]).join(two, ["a2", "b2"]).select("u", "v"), "links")
    near = edges(_links(_first_cells(met, block), ["tok", "chunk"], sets, percent))
    roots = written(components(near, "u", "v").select("node.a", "node.b", F.xxhash64("root.a", "root.b").alias("root")), "first-roots")
    labelled = met.join(roots, ["a", "b"], "left").withColumn("root", F.coalesce("root", F.xxhash64("a", "b")))
    rest = edges(_links(_rest_cells(written(labelled, "labelled"), block), ["tok", "big", "x", "y"], sets, percent))
    last = components(near.union(rest), "u", "v").select("node.a", "node.b", F.col("root.doc_id").alias("root_id"), F.lit(True).alias("linked"))
    classes_of = written(firsts.join(last, ["a", "b"], "left").select(
        "a", "b", F.when(F.col("linked"), F.col("root_id")).otherwise(F.col("doc_id")).alias("component_id")), "classes")
    out = marked.drop("bits").join(classes_of, ["a", "b"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: size of the shingle set and Jaccard component of every document."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))


ORACLE_SQL = r"""
with recursive w as (
  select doc_id, row_number() over () as row_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select doc_id, row_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) end as s from w),
e as (select row_id, unnest(s) as g from s),
o as (select a.row_id as a, b.row_id as b, count(*) as c from e a join e b on a.g = b.g and a.row_id < b.row_id group by all),
l as (select a, b from o join s x on x.row_id = a join s y on y.row_id = b where 100 * c >= 85 * (len(x.s) + len(y.s) - c)),
both_ways as (select a, b from l union select b, a from l),
reach as (select row_id as a, row_id as b from s union select r.a, t.b from reach r join both_ways t on t.a = r.b),
least as (select r.a, min(doc_id) as component_id from reach r join s on s.row_id = r.b group by 1)
select doc_id, len(s)::bigint as n_shingles, component_id from s join least on a = row_id
"""
