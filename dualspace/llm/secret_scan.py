"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed: its blob id is the SHA-256
of its text. The ledger (a Parquet table, appended to) records which rule
versions have been run on which blob, with the findings. A scan reads the
ledger, runs only the (blob, rule version) pairs that it lacks, appends them
in one atomic Parquet commit, and joins the findings back to all paths. A
second scan of the same history therefore scans nothing; a new rule version
is run on every blob once, old rules are not run again.

Copies: blobs are pre-aggregated on the map side, so a blob that a third of
all paths share is scanned once and shuffled once per map task; the join back
to the paths is a plain equi-join that AQE may split.

Defined cases: a null text is the empty blob; an empty text has no findings;
repeated rows each get the blob's findings; null keys are kept; whole texts
are scanned, whatever their length; columns other than the keys and the text
are ignored, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dualspace.llm.common import free_name, scratch_path, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose `group` has fewer than `min_length` characters are
    dropped. `hints`: lower-case strings of which a matching text holds one (none: always run)."""
    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1
    hints: tuple[str, ...] = ()
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# fixed values: the base kinds in their order, then the further kinds
BASE_RULES = (
    Rule("assign", r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6,
         ("passw", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
_KEY = r"[A-Z\x20]{0,40}PRIVATE KEY(?: BLOCK)?-----"
RULES = BASE_RULES + (
    # from BEGIN through END, or BEGIN alone if no END comes before the next BEGIN
    Rule("private_key", rf"-----BEGIN {_KEY}(?:[^-]*+(?:-(?!----BEGIN |----END {_KEY})[^-]*+)*+-----END {_KEY})?", 0, 1,
         ("private key-----", "private key block-----"), 2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, ("eyj",)),
    Rule("vcs_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)

LEDGER_SCHEMA = "blob string, rules array<string>, findings array<struct<rule:string,start:int,end:int>>"


def find(text: str, rules: Sequence[Rule], compiled: dict[str, re.Pattern]) -> list[tuple[str, int, int]]:
    """(rule key, start, end) in code points, end exclusive, of every kept match."""
    low, out = None, []
    for r in rules:
        if r.hints:
            low = text.lower() if low is None else low
            if not any(h in low for h in r.hints):
                continue
        for m in compiled[r.key].finditer(text):
            if m.end(r.group) - m.start(r.group) >= r.min_length:
                out.append((r.key, m.start(), m.end()))
    return out


def _scan_kernel(rules: Sequence[Rule]):
    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa
        compiled = {r.key: re.compile(r.pattern) for r in rules}
        finding = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            todo = b.column(2).to_pylist()
            found = []
            for text, keys in zip(b.column(1).to_pylist(), todo):
                hits = find(text, [r for r in rules if r.key in keys], compiled)
                found.append([{"rule": k, "start": s, "end": e} for k, s, e in hits])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(todo, pa.list_(pa.string())), pa.array(found, finding)],
                names=["blob", "rules", "findings"])
    return scan


def blob_id(text: str = "text") -> Column:
    return F.sha2(text_or_empty(text), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none if nothing was ever committed there."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def scan_unseen(versions: DataFrame, ledger_path: str, rules: Sequence[Rule] = RULES, text: str = "text") -> None:
    """Scan the (blob, rule version) pairs that the ledger lacks and append them to it."""
    spark = versions.sparkSession
    blobs = (versions.select(blob_id(text).alias("blob"), text_or_empty(text).alias("body"))
             .groupBy("blob").agg(F.first("body").alias("body")))
    # a blob has at most one ledger row per rule version, so this list is bounded
    seen = read_ledger(spark, ledger_path).groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    todo = F.when(F.col("seen").isNull(), wanted).otherwise(F.array_except(wanted, F.col("seen")))
    unseen = blobs.join(seen, "blob", "left").select("blob", "body", todo.alias("todo")).where(F.size("todo") > 0)
    unseen.mapInArrow(_scan_kernel(rules), LEDGER_SCHEMA).write.mode("append").parquet(ledger_path)


def blob_findings(spark: SparkSession, ledger_path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, findings) of the blobs with a finding under the given rule versions."""
    keys = [r.key for r in rules]
    own = F.filter("findings", lambda f: f["rule"].isin(keys))
    return (read_ledger(spark, ledger_path).select("blob", own.alias("f")).where(F.size("f") > 0)
            .groupBy("blob").agg(F.flatten(F.collect_list("f")).alias("findings")))


def scan_history(versions: DataFrame, keys: Sequence[str], ledger_path: str, rules: Sequence[Rule] = RULES,
                 text: str = "text") -> DataFrame:
    """Findings of every path: the `keys` columns, blob, findings
    (array of struct<rule, start, end>, sorted by start and then rule order; empty if none)."""
    scan_unseen(versions, ledger_path, rules, text)
    paths = versions.select(*keys, blob_id(text).alias("blob"))
    hits = blob_findings(versions.sparkSession, ledger_path, rules)
    order = F.array(*[F.lit(r.key) for r in rules])
    ranked = F.array_sort(F.transform("findings", lambda f: F.struct(
        f["start"].alias("start"), F.array_position(order, f["rule"]).alias("rank"), f["end"].alias("end"),
        f["rule"].alias("rule"))))
    back = F.transform(F.coalesce(ranked, F.array().cast("array<struct<start:int,rank:bigint,end:int,rule:string>>")),
                       lambda f: F.struct(f["rule"].alias("rule"), f["start"].alias("start"), f["end"].alias("end")))
    return paths.join(hits, "blob", "left").select(*keys, "blob", back.alias("findings"))


def _mask_kernel(mask: str, text_at: int, spans_at: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            out = []
            for text, spans in zip(b.column(text_at).to_pylist(), b.column(spans_at).to_pylist()):
                if spans:
                    parts, at = [], 0
                    for s, e in sorted((x["start"], x["end"]) for x in spans):
                        if s >= at:
                            parts += [text[at:s], mask]
                        at = max(at, e)
                    text = "".join(parts) + text[at:]
                out.append(text)
            cols = [c for i, c in enumerate(b.columns) if i != spans_at]
            names = [n for i, n in enumerate(b.schema.names) if i != spans_at]
            cols[text_at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def redact(versions: DataFrame, ledger_path: str, rules: Sequence[Rule] = RULES, text: str = "text",
           mask: str = "[SECRET]") -> DataFrame:
    """`versions` with every finding in its text replaced by `mask`: overlapping
    findings become one mask; texts without findings (null too) stay as they are. Row count,
    columns and their types stay; a text column that is no string is not supported."""
    scan_unseen(versions, ledger_path, rules, text)
    blob, found = free_name(versions, "_ds_blob"), free_name(versions, "_ds_findings")
    hits = blob_findings(versions.sparkSession, ledger_path, rules).withColumnsRenamed({"blob": blob, "findings": found})
    joined = versions.withColumn(blob, blob_id(text)).join(hits, blob, "left").drop(blob)
    cols = joined.columns
    return joined.mapInArrow(_mask_kernel(mask, cols.index(text), cols.index(found)), versions.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the findings of every document, as counts, digest and span list."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    found = scan_history(docs, ["doc_id"], scratch_path(spark, "secret-ledger"))
    kind = lambda f: F.split_part(f["rule"], F.lit("@"), F.lit(1))
    spans = lambda c: F.array_join(F.transform(c, lambda f: F.concat_ws(":", kind(f), f["start"], f["end"])), ",")
    count = lambda k: F.size(F.filter("findings", lambda f: kind(f) == k)).cast("long")
    base = F.filter("findings", lambda f: kind(f).isin([r.kind for r in BASE_RULES]))
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
                        F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("findings")).alias("spans"))
