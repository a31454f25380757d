"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Every row is judged by its own text: rows with a null id or one that other rows have too are kept or dropped by
themselves. Empty tables pass through; further columns of documents are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm import debruijn, decontaminate, minhash, mixing, toxicity
from meshwork.llm.common import materialize, read_table, with_row_id

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones of docs, doesn't reject."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model, keep=COLUMNS).filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, linked at 0.8, that with the smallest id; of rows that share it, one."""
    return minhash.keep_first(docs.select(*COLUMNS), **minhash.AT_80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words in runs of 35 that stand elsewhere too; untouched texts stay as they are."""
    out = debruijn.dedup(docs.select(*COLUMNS), keep=COLUMNS)
    cut = F.col("n_removed") > 0
    out = out.withColumn("text", F.when(cut, F.col("kept_text")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage occurs, told apart by row, so null and repeated ids do no harm."""
    rows = with_row_id(docs.select(*COLUMNS))
    found = decontaminate.find(rows, read_table(spark, sf_dir, "benchmark"), keep=("_rid",)).select(F.col("_rid").alias("_leak")).distinct()
    found = materialize(found, "leaks")
    return rows.join(found, F.col("_rid") == F.col("_leak"), "left_anti").drop("_rid")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, target and the words taken."""
    return mixing.mix_documents(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: Toxicity, the near-duplicate signature and banded alignment aren't expressible in SQL; the tests hold the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
