"""Queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import bpe, langid, lines, minhash, mixing, partitions, prefix_tokens, quality, rules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": langid.query,
    "op2_mixing": mixing.query,
    "op3_ann_partitions": partitions.query,
    "op4_quality_classifier": quality.query,
    "op5_quality_rules": rules.query,
    "op6_line_dedup": lines.query,
    "op7_near_duplicates": minhash.query,
    "op8_token_counts": prefix_tokens.query,
    "op9_warc": warc.query,
    "op10_byte_bpe": bpe.query,
}

#: The others learn, follow links or tokenise; their tests compare them with brute force, libraries and held-out rows.
ORACLES: dict[str, str] = {"op9_warc": warc.ORACLE_SQL}
