"""URL filter: rules first, else gradient-boosted trees on lexical features.

A rule names a host and a path prefix; it fits its host and all subdomains,
and the longest fitting rule decides. Every other URL is judged by boosted trees
(MLlib) over lexical features: lengths, path depth, digit ratio, character
entropy, parameter count, marks of the host, and how often its host suffix
is blocked among the labelled URLs. Training reads at most `MAX_LABELLED` labelled
URLs (those with the smallest hashed id); judging reads all, in one pass: the
suffix statistics and the trees are small and join by hash.

Defined cases: a null URL or one without `://` has empty host and path, fits no rule
and is judged by its features like any other; repeated rows and null ids are judged
alike; other columns are ignored; without labelled URLs of both kinds every URL
that no rule fits is allowed; an empty table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


# fixed values
RULES = (UrlRule("allow", "org"), UrlRule("block", "example.org", "/es/"), UrlRule("block", "example.org", "/en/1"),
         UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/"))
#: host terms that make a labelled URL a blocked one
BLOCK_TERMS = ("casino", "pills", "bets", "adult", "spam", "ads-")
MAX_LABELLED = 20_000
TREES, DEPTH = 12, 3
NUMBERS = ("url_chars", "host_chars", "depth", "longest_part", "digit_ratio", "entropy", "n_params", "host_labels", "host_hyphens",
           "host_digits", "suffix_log", "suffix_blocked")


def host_and_path(url: Column) -> tuple[Column, Column]:
    whole = "(?s)^.*?://([^/?#]*)([^?#]*)"
    at = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(at, whole, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(at, whole, 2)


def longest_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> tuple[Column, Column]:
    """(rule name, its verdict) of the longest fitting rule; nulls if none fits."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name.otherwise(none), verdict.otherwise(none))


def lexical(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, suffix and the features that the URL alone gives."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("u"),
                        host.alias("host"), path.alias("path"))
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    chars = F.filter(F.split("u", ""), lambda c: c != "")
    size = F.greatest(F.length("u"), F.lit(1))
    shares = F.transform(F.array_distinct(chars), lambda c: (
        F.length("u") - F.length(F.replace(F.col("u"), c, F.lit("")))) / size)
    parts = F.split("path", "/")
    params = F.regexp_extract("u", "(?s)\\?([^#]*)", 1)
    return rows.select(
        "page_id", "host", "path", F.element_at(F.split("host", "[.]"), -1).alias("suffix"),
        F.length("u").cast("double").alias("url_chars"), F.length("host").cast("double").alias("host_chars"),
        count(F.col("path"), "/").cast("double").alias("depth"),
        F.array_max(F.transform(parts, lambda p: F.length(p))).cast("double").alias("longest_part"),
        (F.length(F.regexp_replace("u", "[^0-9]", "")) / size).alias("digit_ratio"),
        F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.ln(p)).alias("entropy"),
        F.when(params == "", 0).otherwise(count(params, "&") + 1).cast("double").alias("n_params"),
        F.size(F.split("host", "[.]")).cast("double").alias("host_labels"),
        count(F.col("host"), "-").cast("double").alias("host_hyphens"),
        F.length(F.regexp_replace("host", "[^0-9]", "")).cast("double").alias("host_digits"))


class UrlModel:
    """Suffix statistics and boosted trees; `trees` is None without both kinds of labels."""

    def __init__(self, labelled: DataFrame, max_labelled: int = MAX_LABELLED):
        """`labelled`: the columns of `lexical` and block (0 or 1)."""
        sample = labelled.orderBy(F.xxhash64("page_id"), "page_id").limit(max_labelled).cache()
        n = F.count(F.lit(1))
        self.suffixes = sample.groupBy("suffix").agg(F.ln(n + 1.0).alias("suffix_log"),
                                                     ((F.sum("block") + 0.5) / (n + 1.0)).alias("suffix_blocked"))
        self.trees = None
        if sample.select("block").distinct().count() == 2:
            stages = [VectorAssembler(inputCols=list(NUMBERS), outputCol="features"),
                      GBTClassifier(labelCol="block", maxIter=TREES, maxDepth=DEPTH, seed=7)]
            self.trees = Pipeline(stages=stages).fit(self._with_suffix(sample).withColumn("block", F.col("block").cast("double")))
        sample.unpersist()

    def _with_suffix(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.suffixes, "suffix", "left").fillna(0.0, ["suffix_log", "suffix_blocked"])

    def judge(self, rows: DataFrame) -> DataFrame:
        """`rows` (of `lexical`) with blocked, a boolean."""
        if self.trees is None:
            return rows.withColumn("blocked", F.lit(False))
        return self.trees.transform(self._with_suffix(rows)).withColumn("blocked", F.col("prediction") == 1.0)


def filter_urls(pages: DataFrame, model: UrlModel, rules: Sequence[UrlRule] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict."""
    rows = model.judge(lexical(pages, key, url))
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", name.alias("rule"),
                       F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))


def labelled_urls(pages: DataFrame, ids: DataFrame, terms: Sequence[str] = BLOCK_TERMS) -> DataFrame:
    """The URLs whose page_id is among `ids` (page_id), labelled by the terms in their hosts."""
    listed = F.lit(False)
    for t in terms:
        listed = listed | F.contains(F.col("host"), F.lit(t))
    return lexical(pages).join(ids.distinct(), "page_id", "left_semi").withColumn("block", listed.cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every page's rule and verdict; trained on the URLs of labelled documents (page_id is their doc_id)."""
    base = sf_dir.rstrip("/")
    pages = spark.read.parquet(f"{base}/pages.parquet").select("page_id", "url")
    ids = spark.read.parquet(f"{base}/labels.parquet").select(F.col("doc_id").alias("page_id"))
    return filter_urls(pages, UrlModel(labelled_urls(pages, ids)))
