"""Sequence packing by Karmarkar-Karp multiway differencing.

Documents become ids, are cut at multiples of the window capacity, and the
pieces are dealt at random (`pack`) or by contiguous stretches of a given order of the
documents (`pack_in_order`) into groups of bounded size. Within a group the
pieces are partitioned into k windows by differencing: the two partial
partitions with the largest spreads are merged so that the fullest windows
of one meet the emptiest of the other, until one partition of near-equal
windows is left. If a window exceeds the capacity, k rises and the group is
partitioned anew.

Scale: ids never leave the task that made them unless asked for (`keep_ids`);
the pieces' lengths and digests are written to the shared folder and dealt out
by row, not by key, so no key can make a group large; a group is one bounded
Arrow batch. Words recur, so ids are looked up per word with a bounded cache,
and only unseen words reach the tokenizer.

Defined cases: a null or empty text is a document of one id (the end id);
repeated rows are packed once each; a null doc_id is kept; other columns are
ignored. An empty table gives no rows. The tokenizer file must be on every worker.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from struct import pack as pack_ids

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dualspace.llm.common import text_or_empty, written

CAPACITY = 4096
GROUP_PIECES = 1024
CACHE_WORDS = 400_000

# fixed values: what the fast path must leave to the tokenizer itself
_SIMPLE = re.compile("([a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7]*)")
_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")


def byte_letters() -> list[str]:
    """The letter that byte-level BPE shows for each byte: itself if printable, else from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class WordIds:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    For Latin-1 texts the tokenizer (lower case, split at white space, letters
    and punctuation apart) works word by word, so words are cached; every
    other text goes to the tokenizer whole."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.letters = byte_letters()
        self.cache_words = cache_words
        self.parts: dict[str, bytes] = {}
        outer = self

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                m = _SIMPLE.fullmatch(word)
                ids = (outer.part(m[1]) + (outer.part(m[2]) if m[2] else b"")) if m else outer.ids(word)
                if len(self) < outer.cache_words:
                    self[word] = ids
                return ids
        self.words = Words()

    def ids(self, text: str) -> bytes:
        import numpy as np
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            shown = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
            ids = [t.id for t in self.model.tokenize(shown)]
            found = pack_ids(f"<{len(ids)}I", *ids)
            if len(self.parts) < self.cache_words:
                self.parts[part] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.ids(text)
        if any(x in text for x in _ODD):
            return self.ids(text)
        return b"".join(map(self.words.__getitem__, text.lower().split()))


def _piece_kernel(path: str, end_id: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        words = WordIds(path)
        tail = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = words.encode(text) + tail
                total = len(ids) // 4
                for at in range(0, total, capacity):
                    piece = ids[4 * at:4 * (at + capacity)]
                    out.append((doc, at, len(piece) // 4, zlib.crc32(piece), total,
                                np.frombuffer(piece, "<u4").tolist() if keep_ids else None))
            cols = list(zip(*out)) or [()] * 6
            types = [b.schema.field(0).type] + [pa.int64()] * 4 + ([pa.list_(pa.int32())] if keep_ids else [])
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + (["ids"] if keep_ids else [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
    return run


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, keep_ids: bool = False,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most `capacity` ids: doc_id, start, length, ids_crc32, doc_tokens [, ids]."""
    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("body"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long"
    return rows.mapInArrow(_piece_kernel(tokenizer, end_id, capacity, keep_ids),
                           schema + (", ids array<int>" if keep_ids else ""))


def difference(lengths: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: `lengths` in k parts of near-equal sums, as lists of positions.

    A partial partition keeps only its non-empty windows, fullest first."""
    heap = [(-n, i, [(n, [i])]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    tick = len(lengths)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k  # so many windows of both must join; the others meet an empty one
        if over > 0:
            cut_a, cut_b = len(a) - over, len(b) - over
            joined = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[cut_a:], reversed(b[cut_b:]))]
            merged = a[:cut_a] + b[:cut_b] + joined
        else:
            merged = a + b
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, tick, merged))
        tick += 1
    return [w for _, w in heap[0][2]] if heap else []


def windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows within `capacity`; their number rises until all fit."""
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        found = difference(lengths, k)
        if all(sum(lengths[i] for i in w) <= capacity for w in found):
            return found
        k += 1


def _pack_kernel(capacity: int):
    def run(key, group):
        import numpy as np
        import pyarrow as pa
        lengths = group.column("length").to_pylist()
        full = [[i] for i, n in enumerate(lengths) if n == capacity]
        rest = [i for i, n in enumerate(lengths) if n < capacity]
        found = full + [[rest[i] for i in w] for w in windows([lengths[i] for i in rest], capacity)]
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n, w in enumerate(found):
            at = 0
            for i in sorted(w):
                seq[i], off[i] = key[0].as_py() << 24 | n, at
                at += lengths[i]
        return group.drop_columns(["grp"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))
    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """`pieces` (a table with a `length` column, at most `capacity` each) with
    sequence_id and offset: where each piece lies. No window exceeds `capacity`."""
    stored = written(pieces.withColumn("_ds_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-stored.count() // group_pieces))
    dealt = stored.withColumn("grp", F.pmod(F.xxhash64("_ds_row"), F.lit(groups)).cast("long")).drop("_ds_row")
    schema = dealt.drop("grp").schema.add("sequence_id", "long").add("offset", "long")
    return dealt.groupBy("grp").applyInArrow(_pack_kernel(capacity), schema)


#: places per sequence number: a document's full pieces, then the window that its last piece opens
PLACE_BITS = 25


def _ordered_kernel(capacity: int):
    def run(group):
        import numpy as np
        import pyarrow as pa
        group = group.sort_by("position")
        lengths, places = group.column("length").to_pylist(), group.column("position").to_pylist()
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for w in windows(lengths, capacity):
            at, first = 0, places[min(w)]
            for i in sorted(w):
                seq[i], off[i] = first << PLACE_BITS | 1 << (PLACE_BITS - 1), at
                at += lengths[i]
        return group.drop_columns(["grp", "position"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))
    return run


def pack_in_order(pieces: DataFrame, capacity: int = CAPACITY, group_places: int = GROUP_PIECES) -> DataFrame:
    """Like `pack`, for the pieces of `cut_documents` with a column `position`, the whole number
    from 0 (below 2^38) that is the document's place in an order. A window holds only pieces
    of one stretch of `group_places` places, and is numbered by its first document's place, so
    sequence_ids rise with the order, up to one stretch. A full piece is a window of
    its own and meets no other; a document has at most one shorter piece, so a stretch holds at
    most `group_places` of them, however long the documents."""
    full = F.col("length") == capacity
    schema = pieces.drop("position").schema.add("sequence_id", "long").add("offset", "long")
    number = F.shiftleft("position", PLACE_BITS).bitwiseOR(F.expr(f"start div {capacity}"))
    whole = pieces.where(full).withColumns({"sequence_id": number, "offset": F.lit(0).cast("long")}).drop("position")
    rest = pieces.where(~full).withColumn("grp", F.expr(f"position div {group_places}"))
    return whole.union(rest.groupBy("grp").applyInArrow(_ordered_kernel(capacity), schema))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: where each piece of every document lies."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return pack(cut_documents(docs, tokenizer_path()))
