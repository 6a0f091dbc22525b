"""Mixing sources to target weights by Pfair scheduling.

The rows of each source are put in a fixed pseudo-random order and cut into
blocks. With integer weights a_s and L their sum, block j of source s may not
run before slot floor(j L / a_s) (its release) and must run before slot
ceil((j + 1) L / a_s) (its deadline). One slot holds one block; each slot goes to
the released block with the earliest deadline (ties: the order of the weights).
Then after any number of slots t each source has run within less than one block
of t a_s / L. The schedule repeats every L slots, so one period, as long as the
weights say, is all that is ever computed one slot at a time.

When a source has no blocks left, a new phase starts with the remaining
sources, their weights renormalised and their windows counted from its first
slot; so every row is placed, and the bound holds within each phase.

Scale: rows meet only within (source, bucket) ranges of about
`bucket_rows` rows, whose offsets are prefix sums of counts; a hot source has more
buckets, not larger ones. What the driver holds is one count per weight entry.
DataFrame functions only.

Defined cases: sources without a weight (null too) share the entry OTHER;
a null key sorts first; rows with equal keys are ordered by source, and
are else interchangeable; text plays no part; every input column is kept, but for
those of the result's own names, which are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OTHER = "other"
#: production weights: the large source held to a quarter, 19 others sharing the rest, unknown sources one share
WEIGHTS = {"src0": 6, **{f"src{i}": 1 for i in range(1, 20)}, OTHER: 1}
BLOCK_ROWS = 64
BUCKET_ROWS = 1024
PRIME = 2_147_483_647
FACTOR = 742_938_285
COLUMNS = ("phase", "block", "release", "deadline", "slot", "offset")


def period(weights: Mapping[str, int]) -> list[str]:
    """One period of the earliest-deadline-first schedule: the source of each slot."""
    total, done, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for t in range(total):
        ready = [s for s, a in weights.items() if done[s] * total // a <= t]
        s = min(ready, key=lambda s: -(-(done[s] + 1) * total // weights[s]))
        done[s] += 1
        out.append(s)
    return out


def phases(weights: Mapping[str, int], blocks: Mapping[str, int]) -> list[dict]:
    """Phases until every source has run out: first slot, and per source its
    weight, first block and the period's slots."""
    left, first, at, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        own = {s: a for s, a in weights.items() if s in left}
        slots: dict[str, list[int]] = {s: [] for s in own}
        for t, s in enumerate(period(own)):
            slots[s].append(t)
        total = sum(own.values())
        last = lambda s, n: (n - 1) // own[s] * total + slots[s][(n - 1) % own[s]]  # noqa: E731  slot of the n-th block
        length = min(last(s, n) for s, n in left.items()) + 1
        out.append({"phase": len(out), "slot0": at, "total": total,
                    "sources": [{"source": s, "weight": own[s], "first": first[s], "slots": slots[s]} for s in own]})
        for s in own:
            ran = length // total * own[s] + sum(t < length % total for t in slots[s])
            first[s] += ran
            left[s] -= ran
        left = {s: n for s, n in left.items() if n}
        at += length
    return out


def _entry(source: str, weights: Mapping[str, int]):
    return F.when(F.col(source).isin(list(weights)), F.col(source)).otherwise(F.lit(OTHER))


def mix(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS, block_rows: int = BLOCK_ROWS, bucket_rows: int = BUCKET_ROWS,
        key: str = "doc_id", source: str = "source") -> DataFrame:
    """`docs` with phase, block, release, deadline, slot and offset (in the block); the
    mix is the order of (slot, offset). The weights are positive whole numbers and name OTHER."""
    if any(a < 1 for a in weights.values()) or OTHER not in weights:
        raise ValueError(f"weights are whole numbers from 1, with an entry {OTHER!r}")
    spark = docs.sparkSession
    spread = F.coalesce(F.pmod(F.pmod(F.col(key), F.lit(PRIME)) * FACTOR, F.lit(PRIME)), F.lit(0)).cast("long")
    rows = docs.drop(*[c for c in COLUMNS if c in docs.columns]).withColumns(
        {"_ds_entry": _entry(source, weights), "_ds_spread": spread})
    counts = rows.groupBy("_ds_entry").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["_ds_entry"]: r["n"] for r in counts.collect()}  # at most one row per weight entry
    buckets = F.create_map(*[x for s in weights for x in (F.lit(s), F.lit(max(1, -(-sizes.get(s, 0) // bucket_rows))))])
    rows = rows.withColumn("_ds_bucket", F.floor(F.col("_ds_spread") * buckets[F.col("_ds_entry")] / F.lit(PRIME)))
    fill = rows.groupBy("_ds_entry", "_ds_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = fill.select("_ds_entry", "_ds_bucket", (F.sum("n").over(
        Window.partitionBy("_ds_entry").orderBy("_ds_bucket")) - F.col("n")).alias("_ds_before"))
    within = F.row_number().over(Window.partitionBy("_ds_entry", "_ds_bucket").orderBy("_ds_spread", key, source)) - 1
    ranked = rows.withColumn("_ds_within", within).join(before, ["_ds_entry", "_ds_bucket"])
    rank = (F.col("_ds_before") + F.col("_ds_within")).cast("long")
    ranked = ranked.withColumns({"block": F.floor(rank / block_rows), "offset": F.pmod(rank, F.lit(block_rows))})

    plan = phases(weights, {s: -(-sizes.get(s, 0) // block_rows) for s in weights})
    spans: dict[str, list] = {}
    for p in plan:
        for s in p["sources"]:
            spans.setdefault(s["source"], []).append(
                {"phase": p["phase"], "slot0": p["slot0"], "total": p["total"], "weight": s["weight"], "first": s["first"], "slots": s["slots"]})
    schema = ("array<struct<_ds_entry:string,_ds_spans:array<struct<phase:int,slot0:bigint,total:bigint,weight:bigint,"
              "first:bigint,slots:array<bigint>>>>>")
    table = json.dumps([{"_ds_entry": s, "_ds_spans": v} for s, v in spans.items()])
    schedule = spark.range(1).select(F.inline(F.from_json(F.lit(table), schema)))
    placed = ranked.join(F.broadcast(schedule), "_ds_entry")  # one row per weight entry
    span = F.element_at(F.filter("_ds_spans", lambda p: p["first"] <= F.col("block")), -1)
    placed = placed.withColumn("_ds_span", span).withColumn("_ds_j", F.col("block") - F.col("_ds_span.first"))
    p, j = F.col("_ds_span"), F.col("_ds_j")
    turn = F.element_at(p["slots"], (F.pmod(j, p["weight"]) + 1).cast("int"))
    return placed.select(
        *[c for c in rows.columns if not c.startswith("_ds_")], p["phase"].alias("phase"), "block",
        (p["slot0"] + F.expr("_ds_j * _ds_span.total div _ds_span.weight")).alias("release"),
        (p["slot0"] + F.expr("((_ds_j + 1) * _ds_span.total + _ds_span.weight - 1) div _ds_span.weight")).alias("deadline"),
        (p["slot0"] + F.expr("_ds_j div _ds_span.weight") * p["total"] + turn).alias("slot"), "offset")


def position(block_rows: int = BLOCK_ROWS):
    """The place in the mix as one whole number, of a row of `mix`: unique, rising with (slot, offset),
    with gaps where a source's last block is not full."""
    return F.col("slot") * block_rows + F.col("offset")


def mixed_order(docs: DataFrame, key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The rows and columns of `docs`, whatever their names, range-partitioned and sorted in the order of the mix."""
    inner = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    mixed = mix(docs.toDF(*inner.values()), key=inner[key], source=inner[source], **options).orderBy("slot", "offset")
    return mixed.select(*[F.col(i).alias(c) for c, i in inner.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: each document's place in the mix."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "source")
    return mix(docs)


def _oracle() -> str:
    """The schedule slot by slot, as a recursive query; the weights and sizes restated."""
    names = ["src0", *[f"src{i}" for i in range(1, 20)], "other"]
    listed = ", ".join(f"'{n}'" for n in names[:-1])
    each = lambda body: f"list_transform(range(1, 22), lambda i: {body})"
    return f"""
with recursive d as (
  select doc_id, source, case when source in ({listed}) then source else 'other' end as entry,
    coalesce((((doc_id % 2147483647) + 2147483647) % 2147483647 * 742938285) % 2147483647, 0) as k from documents),
r as (select *, row_number() over (partition by entry order by k, doc_id nulls first, source nulls first) - 1 as rank from d),
cfg as (
  select [{', '.join(['6'] + ['1'] * 20)}]::bigint[] as a,
    list_transform([{', '.join(f"'{n}'" for n in names)}], lambda s: coalesce(map_from_entries(e)[s], 0)) as n
  from (select list((entry, c)) as e from (select entry, (count(*) + 63) // 64 as c from d group by entry))),
sim as (
  select -1::bigint as slot, 0 as phase, 0::bigint as slot0, {each('0::bigint')} as ran, {each('0::bigint')} as before,
    0::bigint as pick, 0::bigint as block, 0::bigint as release, 0::bigint as deadline, 0 as own_phase
  union all
  select slot + 1, case when ended then phase + 1 else phase end, case when ended then slot + 2 else slot0 end,
    case when ended then {each('0::bigint')} else now end,
    case when ended then {each('before[i] + now[i]')} else before end,
    p, before[p] + ran[p], slot0 + ran[p] * total // a[p], slot0 + best // 1000, phase
  from (
    select *, before[p] + now[p] = n[p] as ended from (
      select *, {each('ran[i] + (i = p)::bigint')} as now from (
        select *, best % 1000 as p from (
          select *, list_min({each('''case when before[i] < n[i] and ran[i] * total // a[i] <= slot + 1 - slot0
            then ((ran[i] + 1) * total + a[i] - 1) // a[i] * 1000 + i end''')}) as best from (
            select sim.slot, sim.phase, sim.slot0, sim.ran, sim.before, cfg.a, cfg.n,
              list_sum({each('case when before[i] < n[i] then a[i] else 0 end')})::bigint as total
            from sim, cfg where slot + 1 < list_sum(n)))))))
select doc_id, source, own_phase as phase, block, release, deadline, slot, rank % 64 as "offset"
from r join sim on [{', '.join(f"'{n}'" for n in names)}][pick] = entry and block = rank // 64 and slot >= 0
"""


ORACLE_SQL = _oracle()
