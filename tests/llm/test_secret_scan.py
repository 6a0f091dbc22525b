import hashlib
import re

from pyspark.sql import functions as F

from dualspace.llm import secret_scan as S
from dualspace.llm.common import scratch_path

PATTERNS = {
    "assign": (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
               r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}


def brute(text):
    out = []
    for rank, (kind, (p, g, least)) in enumerate(PATTERNS.items()):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(p, text or "") if len(m[g]) >= least]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def test_query_equals_brute_force(spark, docs, corpus, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(S.query(spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"])
    want = sorted(corpus, key=lambda r: r[0])
    assert [r["doc_id"] for r in got] == [r[0] for r in want]
    some = 0
    for r, w in zip(got, want):
        hits = brute(w[1])
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in hits)
        some += len(hits)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), w
        assert r["spans"] == text
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(h[0] == k for h in hits) for k in PATTERNS)
    assert some > 20


def test_ledger_scans_only_unseen_pairs(spark, docs):
    path = scratch_path(spark, "ledger-test")
    S.scan_unseen(docs, path, S.BASE_RULES)
    n = S.read_ledger(spark, path).count()
    assert n == docs.select(S.blob_id().alias("b")).distinct().count()
    S.scan_unseen(docs, path, S.BASE_RULES)
    assert S.read_ledger(spark, path).count() == n  # nothing left to scan
    new = spark.createDataFrame([(900, "new secret: abcdefghij")], "doc_id long, text string")
    S.scan_unseen(new, path, S.BASE_RULES)
    assert S.read_ledger(spark, path).count() == n + 1
    newer = (*S.BASE_RULES[:2], S.Rule("hex", r"[0-9a-f]{32,}", 0, 32, version=2))
    S.scan_unseen(docs, path, newer)
    added = S.read_ledger(spark, path).where(F.array_contains("rules", "hex@2"))
    assert added.count() == n and added.where(F.size("rules") > 1).count() == 0  # only the changed rule ran
    again = {r["doc_id"]: r["findings"] for r in S.scan_history(docs, ["doc_id"], path, newer).collect()}
    assert all(f["rule"] != "hex@1" for fs in again.values() for f in fs)


def test_redaction_and_empty_table(spark, docs, empty):
    out = S.redact(docs.withColumn("blob", F.lit(1)).withColumn("findings", F.lit("x")), scratch_path(spark, "ledger-test"))
    rows = out.collect()
    assert out.columns == [*docs.columns, "blob", "findings"] and len(rows) == docs.count()
    assert all(not brute(r["text"]) for r in rows if r["text"]) and any("[SECRET]" in (r["text"] or "") for r in rows)
    assert [r["text"] for r in rows if r["doc_id"] == 200] == [None]
    assert S.scan_history(empty, ["doc_id"], scratch_path(spark, "ledger-test")).count() == 0


def test_whole_private_keys_are_masked(spark):
    body = "\n".join("MIIEpAIBAAKCAQEA7-x+/Zq" * 3 for _ in range(20))
    key = lambda kind: f"-----BEGIN {kind}-----\nVersion: x - 1\n\n{body}\n-----END {kind}-----"
    head = "-----BEGIN EC PRIVATE KEY-----"
    texts = [f"a {key('RSA PRIVATE KEY')} b {key('PRIVATE KEY')} c", f"x\n{key('PGP PRIVATE KEY BLOCK')}\ny", f"t {head} no end",
             f"{head} cut {key('RSA PRIVATE KEY')} z", f"secret: {key('PRIVATE KEY')} q", f"{key('PUBLIC KEY')}", head * 20_000]
    want = ["a [SECRET] b [SECRET] c", "x\n[SECRET]\ny", "t [SECRET] no end", "[SECRET] cut [SECRET] z", "[SECRET] q",
            texts[5], "[SECRET]" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = S.redact(docs, scratch_path(spark, "ledger-test")).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == want
    assert next(r.version for r in S.RULES if r.kind == "private_key") > 1
