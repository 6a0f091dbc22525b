"""Registered prompt / answer / judge plans (P1-P10, W6) over document pools
and conversation answer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dualspace.operators import prompts as P
from dualspace.sources import qa
from dualspace.sources.answers import answer_pairs

JUDGE_MODEL = "judge-model"
GEN_MODEL = "gen-model"


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, chunks, gold = qa.load_benchmark("struct_of_arrays", spark, sf_dir)
    strategy = (F.when(F.col("pool_id").cast("bigint") % 3 == 0, "decay")
                .when(F.col("pool_id").cast("bigint") % 3 == 1, "naive").otherwise("no_context"))
    q = questions.select("qid", "pool_id", "query", strategy.alias("strategy"))
    g = gold.select(F.col("qid").alias("pool_id"), "chunk_idx", F.lit(True).alias("g"))
    r = chunks.join(g, ["pool_id", "chunk_idx"], "left").select(
        F.col("pool_id").alias("qid"), "pool_id", "chunk_idx",
        F.when(F.col("g"), "primary").otherwise("structural").alias("role"))
    r = r.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "role").orderBy("chunk_idx"))).where(
        F.col("rank") <= F.when(F.col("role") == "primary", 5).otherwise(10))
    return P.build_prompts(q, r, chunks)


def q_prompt_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir)


def q_extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select("qid", P.extractive_answer("prompt").alias("answer"))


def q_answer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select("qid", P.answer_key("prompt", F.lit(GEN_MODEL)).alias("key"))


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge replies of several shapes, one per answer pair: valid true / false,
    no JSON, malformed JSON, missing key, multi-line object, string "false"."""
    p = answer_pairs(spark, sf_dir)
    v = F.col("conv_id") % 7
    rat = F.concat(F.lit("turn "), F.col("turn").cast("string"))
    obj = lambda c: F.concat(F.lit('{"correct": '), F.lit(c), F.lit(', "rationale": "'), rat, F.lit('"}'))
    raw = (F.when(v == 0, F.concat(F.lit("note "), obj("true"), F.lit(" end")))
           .when(v == 1, F.concat(F.lit("verdict: "), obj("false")))
           .when(v == 2, F.col("pred"))
           .when(v == 3, F.concat(F.lit('{"correct": maybe, "rationale": "'), rat, F.lit('"}')))
           .when(v == 4, F.concat(F.lit('{"rationale": "'), rat, F.lit('"}')))
           .when(v == 5, F.concat(F.lit('answer\n{\n  "correct": true,\n  "rationale": "'), rat, F.lit('"\n}\n')))
           .otherwise(obj('"false"')))
    return p.select("conv_id", "turn", "gold", "pred", raw.alias("raw"))


def q_judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = judge_replies(spark, sf_dir)
    j = P.parse_judge("raw")
    return r.select("conv_id", "turn", j["correct"].alias("correct"), j["rationale"].alias("rationale"),
                    j["raw"].alias("raw_preview"))


def q_judge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = answer_pairs(spark, sf_dir)
    query = F.concat(F.lit("conversation "), F.col("conv_id").cast("string"))
    return p.select("conv_id", "turn", P.judge_key(query, "pred", "gold", F.lit(JUDGE_MODEL)).alias("key"),
                    F.length(P.judge_prompt(query, "gold", "pred")).alias("prompt_chars"))


QUERIES = {
    "prompt_sections": q_prompt_sections,
    "extractive_answer": q_extractive_answer,
    "answer_keys": q_answer_keys,
    "judge_parse": q_judge_parse,
    "judge_keys": q_judge_keys,
}
