"""Queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshwork.llm import debruijn, decontaminate, exact_substrings, langid, licenses, minhash, mixing, quality, toxicity, warc
from meshwork.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def over(f: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: f(*(read_table(spark, sf_dir, t) for t in tables))


def queries() -> dict[str, Query]:
    return {
        "op1_license_scan": over(licenses.query, "documents"),
        "op2_quality_rules": over(quality.query, "documents"),
        "op3_warc": over(warc.query, "pages"),
        "op4_toxicity": over(toxicity.query, "documents", "labels"),
        "op5_minhash_near_dedup": over(minhash.query, "documents"),
        "op6_suffix_array_dedup": over(exact_substrings.query, "documents"),
        "op7_benchmark_decontamination": over(decontaminate.query, "documents", "benchmark"),
        "op8_substring_dedup": over(debruijn.query, "documents"),
        "op9_language_id": over(langid.query, "documents"),
        "op10_mixing": over(mixing.query, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality.SQL, "op3_warc": warc.SQL, "op6_suffix_array_dedup": exact_substrings.SQL, "op8_substring_dedup": debruijn.SQL, "op10_mixing": mixing.SQL}
