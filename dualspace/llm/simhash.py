"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into segments. If two fingerprints differ in at
most k bits, then for radii r_i with sum(r_i + 1) = k + 1 some segment i
differs in at most r_i bits (else the differences would sum to k + 1). So
each fingerprint is entered in one table per segment under its segment value
and looks up, in each table, the Hamming ball of radius r_i around its own
value; matches are verified over all 64 bits. Of two values that differ in a
set of bits, only the one holding the highest of these bits looks up the
other, so each near pair of values meets once.

Scale: equal fingerprints are collapsed first. A (segment, value) bucket with
more than `block` entries or lookups is cut into a grid of blocks; a task sees
at most `block` entries at a time and passes on only a spanning forest of
the links that it verifies, never all pairs of a group. Three segments suit
up to about 10^8 distinct fingerprints; use `segments=2` (radii 2 and 1) beyond.

Defined cases: a null or wordless text has fingerprint 0, which links like any
other; texts of any length are hashed whole; repeated rows give repeated
result rows; a null doc_id is kept (component_id is the smallest non-null id, null
if there is none); other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dualspace.llm.common import broadcast_checked, written
from dualspace.llm.components import components

BITS = 64
#: hot buckets are listed to all tasks up to this count, joined by a shuffle beyond
HOT_LIST_ROWS = 20_000


def simhash(text: bytes, shingle: int = 4) -> int:
    """Fingerprint of a UTF-8 text: bit set where over half the shingle hashes have it."""
    import numpy as np
    from xxhash import xxh64_intdigest
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space bytes
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1:].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        h = np.array([xxh64_intdigest(joined[s:e], 42) for s, e in
                      zip(starts[at:at + (1 << 15)], ends[at:at + (1 << 15)])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def _fingerprint_kernel(shingle: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            fp = [simhash(t, shingle) for t in b.column(1).to_pylist()]
            fp = pa.array([f - (1 << 64) if f >> 63 else f for f in fp], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], names=["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    return rows.mapInArrow(_fingerprint_kernel(shingle), f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def segment_plan(segments: int, max_bits: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment; sum of radius + 1 is max_bits + 1."""
    if not 1 <= segments <= max_bits + 1:
        raise ValueError("use 1 to max_bits + 1 segments")
    spare, plan, shift = max_bits + 1 - segments, [], 0
    for i in range(segments):
        width = BITS // segments + (i < BITS % segments)
        plan.append((shift, width, spare // segments + (i >= segments - spare % segments)))
        shift += width
    return plan


def lookups(fps: DataFrame, segments: int, max_bits: int) -> DataFrame:
    """(seg, key, fp, entry): one entry and the ball of lookups per segment."""
    parts = []
    for seg, (shift, width, radius) in enumerate(segment_plan(segments, max_bits)):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        masks = [(sum(1 << i for i in c), 1 << c[-1]) for r in range(1, radius + 1) for c in combinations(range(width), r)]
        ball = F.array(F.struct(F.lit(True).alias("entry"), F.lit(0).cast("long").alias("mask")),
                       F.struct(F.lit(False).alias("entry"), F.lit(0).cast("long").alias("mask")))
        if masks:
            own = F.filter(F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(h).cast("long").alias("high")) for m, h in masks]),
                           lambda m: F.col("value").bitwiseAND(m["high"]) != 0)
            ball = F.concat(ball, F.transform(own, lambda m: F.struct(F.lit(False).alias("entry"), m["mask"].alias("mask"))))
        parts.append(fps.select("fp", value.alias("value")).select("fp", "value", F.explode(ball).alias("b")).select(
            F.lit(seg).cast("tinyint").alias("seg"), F.col("value").bitwiseXOR(F.col("b.mask")).alias("key"), "fp", "b.entry"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _verify_kernel(max_bits: int, pairs_at_once: int = 1 << 21):
    """Rows sorted by (seg, key, ei, lj, entries first): verified links of each
    cell, as a spanning forest of each batch of links."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        cell, held = None, np.empty(0, np.uint64)  # the open cell and its entries so far

        def forest(a, b):
            parent: dict[int, int] = {}

            def root(x):
                while (p := parent.setdefault(x, x)) != x:
                    parent[x] = parent[p]
                    x = p
                return x
            keep = []
            for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
                x, y = root(x), root(y)
                if x != y:
                    parent[x] = y
                    keep.append(i)
            return a[keep], b[keep]

        for rb in batches:
            if not rb.num_rows:
                continue
            ids = np.stack([rb.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            fp = rb.column(4).to_numpy().view(np.uint64)
            entry = rb.column(5).to_numpy(zero_copy_only=False)
            new = np.empty(rb.num_rows, bool)
            new[0] = cell is None or bool((ids[:, 0] != cell).any())
            new[1:] = (ids[:, 1:] != ids[:, :-1]).any(axis=0)
            group = np.cumsum(new) - (0 if not new[0] else 1)
            entries = np.concatenate((np.empty(0, np.uint64) if new[0] else held, fp[entry]))
            of = np.concatenate((np.zeros(0 if new[0] else len(held), np.int64), group[entry]))
            n_groups = int(group[-1]) + 1
            counts = np.bincount(of, minlength=n_groups)
            first = np.cumsum(counts) - counts
            q, qg = fp[~entry], group[~entry]
            each = counts[qg]
            ends = np.cumsum(each)
            links_a, links_b, lo = [], [], 0
            while lo < len(q):
                base = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + pairs_at_once, "right")))
                e = each[lo:hi]
                left = np.repeat(q[lo:hi], e)
                at = np.arange(len(left)) - np.repeat(np.cumsum(e) - e, e) + np.repeat(first[qg[lo:hi]], e)
                right = entries[at]
                near = (left != right) & (np.bitwise_count(left ^ right) <= max_bits)
                links_a.append(left[near])
                links_b.append(right[near])
                lo = hi
            cell = ids[:, -1]
            held = entries[of == n_groups - 1]
            a, b = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (links_a, links_b))
            if len(a):
                a, b = forest(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
    return run


def near_links(fps: DataFrame, segments: int = 3, max_bits: int = 4, block: int = 2048) -> DataFrame:
    """(a, b): links whose connected components are those of all pairs of distinct
    `fp` values within `max_bits`. `fps` holds each fp once."""
    rows = lookups(fps, segments, max_bits)
    n_entries, n_lookups = F.sum(F.col("entry").cast("long")), F.sum((~F.col("entry")).cast("long"))
    hot = rows.groupBy("seg", "key").agg(F.ceil(n_entries / block).cast("int").alias("ne"),
                                         F.ceil(n_lookups / block).cast("int").alias("nl")).where("ne > 1 or nl > 1 and ne > 0")
    hot = broadcast_checked(written(hot, "hot-buckets"), HOT_LIST_ROWS)
    cells = rows.join(hot, ["seg", "key"], "left").select(
        "seg", "key", "fp", "entry", F.coalesce("ne", F.lit(1)).alias("ne"), F.coalesce("nl", F.lit(1)).alias("nl"))
    own = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    across = F.when(F.col("entry"), F.col("nl")).otherwise(F.col("ne"))
    cells = cells.withColumn("x", F.explode(F.sequence(F.lit(0), across - 1))).select(
        "seg", "key", F.when(F.col("entry"), own("ne")).otherwise(F.col("x")).alias("ei"),
        F.when(F.col("entry"), F.col("x")).otherwise(own("nl")).alias("lj"), "fp", "entry")
    cells = cells.repartition("seg", "key", "ei", "lj").sortWithinPartitions("seg", "key", "ei", "lj", F.desc("entry"))
    return cells.mapInArrow(_verify_kernel(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, segments: int = 3, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable
    over links of at most `max_bits` differing bits."""
    marked = written(fingerprints(docs, shingle, key, text), "fingerprints")
    first = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(near_links(first.select("fp"), segments, max_bits)).withColumnRenamed("node", "fp")
    rooted = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = written(rooted.join(least, "root").select("fp", "component_id"), "classes")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: fingerprint and near-duplicate component of every document."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")
