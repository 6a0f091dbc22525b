"""Deterministic sharded WARC writer and reader.

Records are gzip members of their own, made without time stamps, and are sorted
by page_id. A file holds the records whose first byte lies in its stretch of
`roll_bytes` compressed bytes, counted over the whole sorted archive; the
counts are sums per range partition plus running sums within, so the files do not
depend on how Spark happened to partition the records. Headers and digests are made
anew from the payload. Each task writes its files under temporary names of its
own; the manifest of the files that the successful attempts wrote is committed as a
table; then the files get their final names; then the final manifest is committed. An
attempt that was lost leaves only a temporary file that no manifest names. Readers
read what the manifest lists.

Of pages with equal payloads of at least `min_revisit` bytes the one with the largest
page_id is written in full; the others are revisit records that refer to it.

The archive folder must be one that pyarrow's file systems open (file, hdfs, s3, gs, abfs).

Scale: payload groups meet as counts per digest, gathered on the map side; a hot payload is one
row of that table. A task holds one record, or one file of about `roll_bytes`, at a time.

Defined cases: a null html is an empty payload, always a response; a null url is an empty
target; pages that repeat the winning page_id are each a response; a null page_id
never wins over another, is written with an empty id, and among nulls only every record is a response;
other columns are ignored; an empty table gives no file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dualspace.llm.common import broadcast_checked, scratch_path, text_or_empty, written

ROLL_BYTES = 1 << 20
MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
HOT_DIGESTS = 20_000
MANIFEST = "file_no long, temporary string, name string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _file_system(uri: str):
    from pyarrow.fs import FileSystem
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return FileSystem.from_uri(uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def member(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit if `refers_to` is given."""
    digest = _base32(hashlib.sha1(payload).hexdigest())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), "WARC-Record-ID: " + record_id(page_id),
        "WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"), "WARC-Date: " + DATE,
        "Content-Type: application/http;msgtype=response", "WARC-Payload-Digest: sha1:" + digest,
        "WARC-Block-Digest: sha1:" + _base32(hashlib.sha1(block).hexdigest()), f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                      "WARC-Refers-To: " + record_id(refers_to)]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)  # zlib's own gzip header holds no time
    return gz.compress(raw) + gz.flush()


def _member_kernel(batches: Iterator) -> Iterator:
    import pyarrow as pa
    for b in batches:
        made = [member(i, u, p, r) for i, u, p, r in zip(*(b.column(n).to_pylist() for n in range(4)))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary()), pa.array([len(m) for m in made], pa.int64())],
                                         names=["page_id", "member", "size"])


def _running_kernel(batches: Iterator) -> Iterator:
    """Adds the bytes before each record in its partition."""
    import numpy as np
    import pyarrow as pa
    at = 0
    for b in batches:
        size = np.fromiter(map(len, b.column(1).to_pylist()), np.int64, b.num_rows)
        ends = at + np.cumsum(size)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ends - size), pa.array(size)],
                                         names=["part", "member", "running", "size"])
        at = int(ends[-1]) if len(ends) else at


def with_referral(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is the page that a revisit refers to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), text_or_empty("url").alias("url"),
                        text_or_empty("html").cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = rows.where(F.octet_length("payload") >= min_revisit).select("digest", "page_id").groupBy("digest").agg(
        F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "winner")
    groups = broadcast_checked(written(groups, "equal-payloads"), HOT_DIGESTS)
    loses = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return rows.join(groups, "digest", "left").select("page_id", "url", "payload", F.when(loses, F.col("winner")).alias("refers_to"))


def _write_kernel(folder: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        fs, root = _file_system(folder)
        attempt, out, done = uuid.uuid4().hex, None, []

        def close():
            nonlocal out
            if out is not None:
                no, name, stream, digest, n, size = out
                stream.close()
                done.append((no, name, f"part-{no:08d}.warc.gz", n, size, digest.hexdigest()))
                out = None
        for b in batches:
            for no, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if out is None or out[0] != no:
                    close()
                    name = f"_temporary/part-{no:08d}-{attempt}"
                    out = [no, name, fs.open_output_stream(f"{root}/{name}"), hashlib.sha256(), 0, 0]
                out[2].write(data)
                out[3].update(data)
                out[4] += 1
                out[5] += len(data)
        close()
        names = ["file_no", "temporary", "name", "records", "bytes", "sha256"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*done)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
    return run


def _rename_kernel(folder: str):
    def run(batches: Iterator) -> Iterator:
        fs, root = _file_system(folder)
        from pyarrow.fs import FileType
        for b in batches:
            for old, new in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if fs.get_file_info(f"{root}/{old}").type == FileType.File:  # else an earlier attempt has renamed it
                    fs.move(f"{root}/{old}", f"{root}/{new}")
                elif fs.get_file_info(f"{root}/{new}").type != FileType.File:
                    raise FileNotFoundError(f"{folder}/{old}")
            yield b
    return run


def write_archive(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write `pages` (page_id, url, html) as WARC files in `folder`, a new one; returns the committed manifest."""
    spark = pages.sparkSession
    members = with_referral(pages, min_revisit).mapInArrow(_member_kernel, "page_id long, member binary, size long")
    ranged = members.withColumn("mark", F.xxhash64("member")).repartitionByRange("page_id", "size", "mark")
    ranged = ranged.sortWithinPartitions("page_id", "size", "mark").select(F.spark_partition_id().alias("part"), "member")
    ordered = written(ranged.mapInArrow(_running_kernel, "part int, member binary, running long, size long"), "warc-order")
    totals = ordered.groupBy("part").agg(F.max(F.col("running") + F.col("size")).alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))  # a row per partition
    at = F.col("before") + F.col("running")
    placed = ordered.join(F.broadcast(before), "part").select(F.floor(at / roll_bytes).cast("long").alias("file_no"), at.alias("at"), "member")
    staged = placed.repartition("file_no").sortWithinPartitions("file_no", "at").select("file_no", "member")
    fs, root = _file_system(folder)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    staged = written(staged.mapInArrow(_write_kernel(folder), MANIFEST), "warc-staged")
    spread = staged.repartition(F.col("file_no"))
    spread.mapInArrow(_rename_kernel(folder), MANIFEST).write.parquet(f"{folder.rstrip('/')}/manifest")
    fs.delete_dir(f"{root}/_temporary")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The committed files of an archive."""
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")


def parse(data: io.BufferedIOBase) -> Iterator[tuple]:
    """Records of an open, decompressed WARC stream, digests checked: the fields of RECORD and the payload."""
    while line := data.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := data.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            head[name] = value.strip()
        block = data.read(int(head["Content-Length"]))
        if data.read(4) != b"\r\n\r\n" or "sha1:" + _base32(hashlib.sha1(block).hexdigest()) != head["WARC-Block-Digest"]:
            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
        payload = block.partition(b"\r\n\r\n")[2]
        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        if head["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"wrong payload digest in {head['WARC-Record-ID']}")
        number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
        refers = head.get("WARC-Refers-To")
        yield (number(head["WARC-Record-ID"]), head["WARC-Target-URI"], int(head["X-Payload-Length"]), digest, head["WARC-Type"],
               None if refers is None else number(refers), payload)


def _read_kernel(folder: str):
    def run(batches: Iterator) -> Iterator:
        import gzip

        import pyarrow as pa
        fs, root = _file_system(folder)
        names = [f.split()[0] for f in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.open(raw) as data:
                    rows = [r[:6] for r in parse(data)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    return run


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records of an archive's committed files: RECORD's columns."""
    return read_manifest(spark, folder).select("name").repartition(F.col("name")).mapInArrow(_read_kernel(folder), RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all pages, written and read back."""
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select("page_id", "url", "html")
    folder = scratch_path(spark, "warc")
    write_archive(pages, folder)
    return read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as n, sha1(b) as h from p),
m as (select *, max(page_id) over (partition by h) as winner from d)
select page_id, n as payload_bytes, h as payload_digest,
  case when n >= 1000 and winner is not null and page_id is distinct from winner then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and winner is not null and page_id is distinct from winner then winner end as refers_to
from m
"""
