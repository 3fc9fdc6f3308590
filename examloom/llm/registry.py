"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from examloom.llm import bcr, bpe, decontaminate, fmindex, hardneg, langid, licenses, merkle, neardup, pages, quality, simhash, tokencount
from examloom.llm.oracles import ORACLE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_suffix_dedup": bcr.op3_suffix_dedup,
    "op7_substring_dedup": fmindex.op7_substring_dedup,
    "op6_minhash_neardup": neardup.op6_minhash_neardup,
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_html_extraction": pages.op2_html_extraction,
    "op4_license_scan": licenses.op4_license_scan,
    "op9_language_id": langid.op9_language_id,
    "op10_token_counts": tokencount.op10_token_counts,
    "op5_bpe_codec": bpe.op5_bpe_codec,
    "op8_quality_rules": quality.op8_quality_rules,
    "op11_simhash_neardup": simhash.op11_simhash_neardup,
    "op12_hard_negatives": hardneg.op12_hard_negatives,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
