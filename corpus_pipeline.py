"""Corpus pipeline: quality, near duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; `run` writes each stage's result as Parquet in the shared folder and
reads it again for the next.

The stages' cases are those of their operators: null and empty texts, repeated
rows, ties, empty tables and further columns pass through each stage. All
but the last return the columns of their input, whatever these are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dualspace.llm import mixing, packing, quality, secret_scan, simhash
from dualspace.llm.common import free_name, scratch_path, text_or_empty, written
from dualspace.session import ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold stay; trained on `labels`."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    score = free_name(docs, "_ds_score")
    kept = quality.scored(docs, quality.train(docs, labels), column=score).where(F.col(score) >= quality.THRESHOLD)
    return kept.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component exactly one row stays: the one with the smallest
    doc_id (null last), then by digests of its text and of the whole row. Rows are
    known by these, not by their ids, so null and repeated ids lose no component."""
    ship_package(spark)
    hashed = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"),
                   F.unhex(F.sha2(text_or_empty(), 256)).alias("text"), F.xxhash64(*hashed).alias("row"))
    classes = simhash.near_duplicates(docs.withColumn("_ds_key", key), key="_ds_key")
    doc, text, row = (free_name(docs, f"_ds_{n}") for n in ("id", "text", "row"))
    stay = classes.select("component_id.*").distinct().select(F.col("id").alias(doc), F.col("text").alias(text), F.col("row").alias(row))
    rows = docs.withColumns({text: key["text"], row: key["row"]})
    kept = rows.join(stay, [text, row]).where(F.col("doc_id").eqNullSafe(F.col(doc)))
    return kept.dropDuplicates(["doc_id", text, row]).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Findings in the texts give way to a mask; n_chars follows the text."""
    ship_package(spark)
    clean = secret_scan.redact(docs, scratch_path(spark, "secret-ledger"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: each stretch of the table holds
    the sources in their target weights while their documents last."""
    ship_package(spark)
    return mixing.mixed_order(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences, whose ids
    rise in the order of the mix. A table keeps no order, so the places in the mix are
    found anew, for the rows as they are cut."""
    ship_package(spark)
    doc = F.struct("doc_id", "source", F.monotonically_increasing_id().alias("row_id"))
    cut = packing.cut_documents(docs.withColumn("_ds_doc", doc), packing.tokenizer_path(), key="_ds_doc")
    pieces = written(cut.select("doc_id.*", *cut.columns[1:]), "pieces")
    mixed = mixing.mix(pieces.where("start = 0").select("row_id", "doc_id", "source"))  # each document has one such piece
    places = written(mixed.select("row_id", mixing.position().alias("position")), "mix-places")
    return packing.pack_in_order(pieces.drop("source").join(places, "row_id").drop("row_id"))


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("secret scan", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
