"""Chat formatting, line cleaning, URL filter, exact top-k and WARC against brute force."""
import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dualspace.llm import chat, cleaning, topk, url_filter, warc

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"create view {name} as select * from read_parquet('{path}/*.parquet')")
    rel = con.sql(sql)
    return sorted(rel.columns), sorted((tuple(v for _, v in sorted(zip(rel.columns, r))) for r in rel.fetchall()), key=repr)


def spark_rows(df):
    return sorted(df.columns), sorted((tuple(v for _, v in sorted(zip(df.columns, r))) for r in df.collect()), key=repr)


# ------------------------------------------------------------------ op3

ODD_TEXTS = ["</s>[INST] ok [/INST]", "a\\b\\\\", "<|end|>\n<|start|>user<|text|>x", "<\\/s>", "\\", "<<s>>", "", None, "é\n<|", "$1 \\Q"]


@pytest.fixture(scope="module")
def talks(spark):
    rng, rows = random.Random(3), []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system"]) if c % 3 else ("user", "assistant")[t % 2],
                         rng.choice(ODD_TEXTS), "clash"))
    rows += [rows[0], (70, None, None, "x", "k"), (70, 1, "to<|text|>ol", "y", "k"), (None, 0, "user", "z", "k")]
    return rows


def test_chat_reads_back_every_turn(spark, talks):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    convs = {}
    for c, t, role, text, _ in talks:
        convs.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        r = got[c]
        assert [(x["role"], x["text"]) for x in r["turns"]] == [x[1:] for x in turns]
        assert r["loss_text"] == "".join(x for _, role, x in turns if role == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
        for m in chat.TEMPLATE.control:
            assert m not in r["formatted"]
        state, bad = "start", 0
        for _, role, _ in turns:
            bad += role not in chat.TEMPLATE.transitions[state]
            state = role if role in chat.TEMPLATE.transitions and role != "start" else state
        assert r["n_violations"] == bad
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_query_equals_sql(spark, talks, tmp_path):
    spark.createDataFrame([t for t in talks if t[0] is not None], "conv_id long, turn long, role string, text string, x string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    assert spark_rows(chat.query(spark, str(tmp_path))) == oracle(chat.ORACLE_SQL, conversations=f"{tmp_path}/conversations.parquet")


# ------------------------------------------------------------------ op8

def brute_counts(text):
    text = text or ""
    w = re.findall(f"[^{SPACE}]+", text)
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(f"[^{SPACE}]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))


def cleaning_texts():
    rng = random.Random(4)
    vocabulary = ["the", "of", "and", "ore.", "thé", "inn", "was,", "***", "|", "a"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 130))) for _ in range(60)]
    texts += ["\n".join(rng.choices(["All rights reserved", "home | news | about | help", "A line of some words here.", "x", "", "\t", "WOW!! YES!! NO!!"],
                                    k=rng.randint(1, 12))) + " w" * rng.randint(0, 80) for _ in range(60)]
    texts += [None, "", " \n \n", "a b c a b c", "a a a a", "a b c", "a a a", "x\x85y z\xa0w", "one two " * 3000]
    return texts + [" ".join(f"{chr(97 + i % 26)}{i}" for i in range(60)) + "."]


def test_cleaning_counts_equal_brute_force_and_sql(spark, tmp_path):
    texts = cleaning_texts()
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")]
    spark.createDataFrame(rows, "doc_id long, text string, words string").write.parquet(f"{tmp_path}/documents.parquet")
    df = cleaning.query(spark, str(tmp_path))
    for r in df.collect():
        n, chars, symbols, dups, rep = brute_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dups, rep), r
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n) and not (r["base_failed"] and r["kept"])
    assert spark_rows(df) == oracle(cleaning.ORACLE_SQL, documents=f"{tmp_path}/documents.parquet")
    assert {r["kept"] for r in df.collect()} == {True, False}


def test_cleaning_removes_lines(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    good = "\n".join(" ".join(word() for _ in range(9)).capitalize() + "." for _ in range(9))
    rows = spark.createDataFrame([(1, good + "\nhome | news | about | help\nLicensed under CC BY.\nmenu"), (2, "BUY!! NOW!! " * 40 + good)], "doc_id int, text string")
    out = {r["doc_id"]: r for r in cleaning.judge(rows).collect()}
    assert out[1]["kept"] and out[1]["clean_text"] == good
    assert not out[2]["kept"]
    assert cleaning.judge(rows.limit(0)).count() == 0


# ------------------------------------------------------------------ op9

def test_url_rules_and_trees(spark, tmp_path):
    def brute(url):
        if not url or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return host, path, max(fits, key=lambda r: len(r.name), default=None)
    rng = random.Random(6)
    urls = [f"https://{rng.choice(['www.', 'M.', ''])}{rng.choice(['example', 'ore-x', 'casino-win', 'free-bets', 'plain'])}.{rng.choice(['org', 'com', 'net', 'ORG'])}"
            f"{rng.choice(['/', '/es/', '/en/1', '/en/2', '/fr/', '/de/', '', '?a=1&b=2', '#x'])}{rng.randint(0, 999)}" for _ in range(600)]
    urls += [None, "", "no scheme", "http://", "http:///es/", "a://b://c/de/", "http://com/de/x", "http://xcom/de/x", "http://É.org/\n?q", "x://" + "a" * 5000]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).write.parquet(f"{tmp_path}/pages.parquet")
    spark.range(0, 610, 2).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r["page_id"]: r for r in url_filter.query(spark, str(tmp_path)).collect()}
    assert len(out) == len(urls)
    free = []
    for i, u in enumerate(urls):
        host, path, rule = brute(u)
        r = out[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.name), u
        if rule:
            assert r["verdict"] == rule.verdict
        else:
            free.append((any(t in host for t in url_filter.BLOCK_TERMS), r["verdict"] == "block", i % 2))
    held = [(a, b) for a, b, odd in free if odd]
    assert np.mean([a == b for a, b in held]) > 0.9 and any(a for a, _ in held)  # the terms are no feature; marks of their hosts are
    spark.range(0).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/labels.parquet", mode="overwrite")
    assert {r["verdict"] for r in url_filter.query(spark, str(tmp_path)).where("rule is null").collect()} == {"allow"}


# ------------------------------------------------------------------ op6

def ranked(rows, k=5):
    """Brute force over rows (id, whole vector): every 50th id's k best other rows."""
    want = []
    for i, (q, x) in enumerate(rows):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), c) for j, (c, y) in enumerate(rows) if j != i and len(x) == len(y))
            want += [(q, n, c, -s) for n, (s, c) in enumerate(best[:k], 1)]
    return sorted(want)


def test_topk_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    x[::7] = x[0]
    x[50] *= 20
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(400)]
    rows += [rows[50], rows[51], (100, rows[3][1], 1), (500, None, 1), (550, [float("nan")] * 24, 1), (600, [None] * 24, 1), (None, [0.0] * 24, 1),
             (650, [1.0, 2.0], 1), (700, [0.5, 1.0], 1), (800, [], 1), (801, [], 1)]
    rows += [rows[7]] * 3 + [rows[0]] * 7
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").write.parquet(f"{tmp_path}/embeddings.parquet")
    part = [(i, [int(np.floor(256 * v)) for v in e]) for i, e, _ in rows if i is not None and e is not None and None not in e and not np.isnan(e).any()]
    want = ranked(part)
    assert sorted(map(tuple, topk.query(spark, str(tmp_path)).collect())) == want
    v = topk.quantised(spark.read.parquet(f"{tmp_path}/embeddings.parquet"))
    small = topk.top_k(v.where("vec_id % 50 = 0"), v, query_block=3, candidate_block=40)
    assert sorted(map(tuple, small.collect())) == want
    assert spark_rows(topk.query(spark, str(tmp_path))) == oracle(topk.ORACLE_SQL, embeddings=f"{tmp_path}/embeddings.parquet")
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_topk_of_a_hot_id_and_of_large_components(spark):
    rng = np.random.default_rng(6)
    rows = [(0 if i % 3 == 0 else i, [int(a) for a in rng.integers(-9, 9, 4)]) for i in range(120)]
    table = lambda scale: spark.createDataFrame([(i, [float(a) * scale for a in v]) for i, v in rows], "vec_id long, embedding array<double>")
    for scale in (1, 1 << 20, 1 << 26):
        v = topk.quantised(table(scale), scale=1)
        got = topk.top_k(v.where("vec_id % 50 = 0"), v, query_block=7, candidate_block=16)
        assert sorted(map(tuple, got.collect())) == ranked([(i, [a * scale for a in x]) for i, x in rows])
    v = topk.quantised(table(1 << 30), scale=1)
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(v.where("vec_id % 50 = 0"), v).collect()
    with pytest.raises(Exception, match="does not fit a long"):
        topk.quantised(table(2.0 ** 70)).collect()


def summed_share(v, ids, k=5):
    at, summed = np.flatnonzero(ids % 50 == 0), []
    qi, ci, s = topk.best_pairs(v[at], at, v, np.arange(len(v)), ids, np.ones(len(v), int), k, None, summed)
    for n, a in enumerate(at):
        score = v @ v[a]
        best = [j for j in np.lexsort((ids, -score)) if j != a][:k]
        assert list(ci[qi == n]) == best and list(s[qi == n]) == list(score[best])
    return summed[0] / (len(at) * v.size)


def test_topk_bounds_drop_pairs_and_stay_exact():
    rng = np.random.default_rng(7)
    falling = (rng.normal(size=(2000, 64)) * (1000 * 0.8 ** np.arange(64))).astype(np.int64)
    level = np.floor(256 * rng.normal(size=(2000, 64)) / 8).astype(np.int64)
    for k in (1, 5):
        assert summed_share(falling, np.arange(2000), k) < 0.25
        assert summed_share(level, np.arange(2000), k) < 0.5


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/embeddings.parquet"), reason="needs the test tables")
def test_topk_sums_less_than_half_of_a_whole_table():
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    v = np.floor(256 * np.array(table.column("embedding").to_pylist(), dtype=np.float64)).astype(np.int64)
    assert summed_share(v, table.column("vec_id").to_numpy()) < 0.5


# ------------------------------------------------------------------ op4

def pages():
    rng = random.Random(9)
    bodies = ["".join(rng.choices("<p>abc é\n\r", k=rng.choice([10, 999, 1000, 3000]))) for _ in range(12)]
    rows = [(i, f"http://x.org/{i} é\r\n", bodies[i % 12] if i % 5 else "u%d" % i * 700, i) for i in range(150)]
    return rows + [(200, None, None, 1), (201, "", "", 1), (None, "n", bodies[0] if len(bodies[0]) > 1000 else "z" * 2000, 1), (149, "again", rows[149][2], 1)]


def test_warc_round_trip_and_sql(spark, tmp_path):
    rows = pages()
    spark.createDataFrame(rows, "page_id long, url string, html string, size long").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = spark_rows(warc.query(spark, str(tmp_path)))
    assert got == oracle(warc.ORACLE_SQL, pages=f"{tmp_path}/pages.parquet")
    assert len(got[1]) == len(rows) and any("revisit" in r for r in got[1])
    digests = Counter(hashlib.sha1((r[2] or "").encode()).hexdigest() for r in rows)
    assert Counter(r[got[0].index("payload_digest")] for r in got[1]) == digests


def test_warc_files_do_not_depend_on_partitions(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string, size long")
    names = ["a", "b"]
    for name, parts in zip(names, (3, 7)):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            warc.write_archive(df.repartition(parts), f"file://{tmp_path}/{name}", roll_bytes=4000)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    files = [{p.name: p.read_bytes() for p in (tmp_path / n).glob("*.warc.gz")} for n in names]
    assert files[0] == files[1] and len(files[0]) > 3
    sizes = [len(b) for b in files[0].values()]
    assert max(sizes) < 4000 + max(len(warc.member(r[0], r[1] or "", (r[2] or "").encode(), None)) for r in pages())
    manifest = warc.read_manifest(spark, f"file://{tmp_path}/a").collect()
    assert {m["name"]: m["sha256"] for m in manifest} == {n: hashlib.sha256(b).hexdigest() for n, b in files[0].items()}
    assert not (tmp_path / "a" / "_temporary").exists()


def test_warc_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archive(none, f"file://{tmp_path}/none").count() == 0
    assert warc.read_archive(spark, f"file://{tmp_path}/none").count() == 0
