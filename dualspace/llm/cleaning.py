"""Quality rules, line first.

Every line with a word is judged alone: by its marks (too many characters per
word that are neither letters, digits nor sentence marks), as navigation (items
between separators, or a short line of at most two words with no end mark), and as
boilerplate (a short line with a stock phrase). Failing lines are removed; a
document that loses more than `MAX_LOST` of its word characters is rejected. Before that,
documents with under 50 words, or with over half their words in repeated
three-word windows, fail by themselves.

Repeated windows: a document's windows are hashed (64 bits per window),
sorted with their positions, and equal neighbours are marked, all within the row: n log n
in the words of a document, no shuffle, no UDF. DataFrame functions only.

Defined cases: a null text has no words and no lines; texts are judged whole; repeated
rows and null ids are judged alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dualspace.llm.common import text_or_empty

MIN_WORDS = 50
MAX_REPEATED = 50      # percent of the words in repeated windows
MAX_LOST = 30          # percent of the word characters in removed lines
MARKS_PER_WORD = 0.3
SHORT_LINE = 200       # characters up to which a stock phrase makes a line boilerplate
# fixed values
SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»·•›"
PHRASES = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "enable javascript",
           "click here", "licensed under", "copyright ©", "sign up for our newsletter", "skip to content")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more."""
    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def marked(s: Column) -> Column:
        twice = lambda x, i: (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                              | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"])), covered)

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        hashed = F.transform(at, lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(F.sort_array(hashed), marked))

    return let(words, windows)


def line_fails(line: Column) -> Column:
    """Whether a line is to be removed."""
    low, trimmed = F.lower(line), F.trim(line)
    n_words = F.size(F.split(F.regexp_replace(trimmed, f"{SPACE}+", " "), " "))
    marks = F.length(F.regexp_replace(line, "[\\p{L}\\p{M}\\p{N}\\s.,;:'’\"()-]+", ""))
    bars = F.length(line) - F.length(F.translate(line, SEPARATORS, ""))
    navigation = (bars >= 3) & (bars * 4 >= n_words) | (n_words <= 2) & ~F.rlike(trimmed, F.lit("[.!?:,;\"”)]$"))
    boilerplate = F.lit(False)
    for p in PHRASES:
        boilerplate = boilerplate | F.contains(low, F.lit(p))
    return (marks > MARKS_PER_WORD * n_words) | navigation | (F.length(line) <= SHORT_LINE) & boilerplate


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, lost_chars (word characters in removed lines), kept, clean_text."""
    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("body"))
    rows = rows.select("doc_id", "body", F.filter(F.split("body", f"{SPACE}+"), lambda w: w != "").alias("words"),
                       F.split("body", "\n").alias("lines"))
    has_word = lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]"))
    judged = F.transform("lines", lambda x: F.struct(x.alias("line"), (has_word(x) & line_fails(x)).alias("bad")))
    lost = F.aggregate(F.filter("judged", lambda x: x["bad"]), F.lit(0).cast("long"), lambda a, x: a + word_chars(x["line"]))
    worded = let(F.filter("lines", has_word), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    rows = rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), word_chars(F.col("body")).alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        worded.cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"), judged.alias("judged"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = rows.withColumns({"base_failed": failed, "lost_chars": lost})
    clean = F.array_join(F.transform(F.filter("judged", lambda x: ~x["bad"]), lambda x: x["line"]), "\n")
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST * F.col("word_chars"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       "lost_chars", kept.alias("kept"), clean.alias("clean_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: counts and verdict of every document."""
    return judge(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")).drop("clean_text")


ORACLE_SQL = r"""
with d as (select row_number() over () as rn, doc_id, coalesce(text, '') as t from documents),
w as (select rn, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
win as (select rn, unnest(range(1, len(ws) - 1)) as p, unnest([ws[i:i + 2] for i in range(1, len(ws) - 1)]) as g from w),
dup as (select rn, p, count(*) over (partition by rn, g) as c from win),
cov as (select rn, count(distinct q) as n from (select rn, unnest([p, p + 1, p + 2]) as q from dup where c > 1) group by rn),
li as (select rn, unnest(string_split(t, chr(10))) as line from w),
lw as (select rn, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) as chars,
         len(string_split(regexp_replace(trim(line, ' '), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) as nw,
         length(regexp_replace(line, '[\pL\pM\pN\t\n\v\f\r .,;:''’"()-]+', '', 'g')) as marks,
         length(line) - length(regexp_replace(line, '[|»·•›]', '', 'g')) as bars
       from li where regexp_matches(line, '[^\x20\x09-\x0D]')),
lf as (select *, marks > 0.3 * nw or (bars >= 3 and bars * 4 >= nw)
         or (nw <= 2 and not regexp_matches(trim(line, ' '), '[.!?:,;"”)]$'))
         or (length(line) <= 200 and regexp_matches(lower(line),
           'all rights reserved|terms of use|terms of service|privacy policy|cookie policy|enable javascript|click here|licensed under|copyright ©|sign up for our newsletter|skip to content')) as bad
       from lw),
per as (select rn, count(*) - count(distinct line) as dups, coalesce(sum(case when bad then chars end), 0)::bigint as lost from lf group by rn),
o as (
  select w.rn, doc_id, len(ws)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(dups, 0)::bigint as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words, coalesce(lost, 0)::bigint as lost_chars
  from w left join cov on cov.rn = w.rn left join per on per.rn = w.rn)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, lost_chars,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost_chars <= 30 * word_chars as kept
from o
"""
