"""Registered queries of this subpackage, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from dualspace.llm import (chat, cleaning, mixing, ngram_join, packing, periodic_runs, quality, secret_scan, simhash,
                           spelling, topk, url_filter, warc)

QUERIES = {
    "op1_secret_scans": secret_scan.query,
    "op2_simhash_near_dedup": simhash.query,
    "op3_chat_formatting": chat.query,
    "op4_warc": warc.query,
    "op5_quality_classifier": quality.query,
    "op6_exact_topk": topk.query,
    "op7_packing": packing.query,
    "op8_quality_rules": cleaning.query,
    "op9_url_filters": url_filter.query,
    "op10_source_mixing": mixing.query,
    "op11_ngram_jaccard_join": ngram_join.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_spelling_variants": spelling.query,
}

ORACLE_SQL = {
    "op3_chat_formatting": chat.ORACLE_SQL,
    "op4_warc": warc.ORACLE_SQL,
    "op6_exact_topk": topk.ORACLE_SQL,
    "op8_quality_rules": cleaning.ORACLE_SQL,
    "op10_source_mixing": mixing.ORACLE_SQL,
    "op11_ngram_jaccard_join": ngram_join.ORACLE_SQL,
}
