"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame expressions only.

Every document gets the exponential key -ln(u) / weight, u from a hash of its id. Within its source documents are
ordered by key; a source's target is met by whole epochs over all of it, then by the documents whose running size fits
what remains. Running sums are two-level: a source is cut into ranges of its keys' ranks in [0, 1), the ranges' sums
are accumulated, and only rows of one range meet in a window, so a source with a third of all rows is no hot task.

Cases: null or empty texts have size 0 and take 0; a null source is a source of its own, last in order; equal ids
share their key and are ordered by their text's hash, equal rows in any order; an empty table gives an empty result; with no words at all every
target is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwork.llm.common import WORD, materialize, with_row_id

#: Weights by the source's place in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words to take in all, as a percentage of all words.
SHARE = 150
#: Most times a source's size that its target may be.
REPEATS = 2


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """In [0.1, 1]: a tenth off for each hundredth of the characters that is a symbol of markup."""
    n = F.length(F.coalesce(text, F.lit("")))
    symbols = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]"))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.1), (n - 10 * symbols) / n)).cast("double")


def uniform(doc_id: Column) -> Column:
    """In (0, 1), from the first 52 bits of the id's MD5."""
    return (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target for (source, source_size): water filling in closed form.

    Sources reach their cap in order of cap / weight. With the caps of the first k filled, the rest share what is left
    by weight; the smallest k at which the next source stays under its cap is the answer.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % n + 1).cast("int")).cast("double")
    cap = (repeats * F.col("source_size")).cast("double")
    out = sizes.withColumns({"_w": w, "_cap": cap})
    filled = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, after, every = filled.rowsBetween(W.unboundedPreceding, -1), filled.rowsBetween(0, W.unboundedFollowing), W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(every) * share / 100.0
    out = out.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    out = out.withColumn("_open", F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.col("_level")))
    out = out.withColumn("_lambda", F.first("_open", ignorenulls=True).over(filled.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    goal = F.when(F.col("_lambda").isNull(), F.col("_cap")).otherwise(F.least(F.col("_lambda") * F.col("_w"), F.col("_cap")))
    return out.select("source", "source_size", goal.alias("target"))


def mix(docs: DataFrame, text: str = "text", quality: Column | None = None, **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of docs, with _rid if docs have it."""
    weight = quality_weight(F.col(text)) if quality is None else quality
    key = -F.log(uniform(F.col("doc_id"))) / weight
    rid = [c for c in ("_rid",) if c in docs.columns]
    rows = materialize(docs.select("doc_id", "source", *rid, size_of(F.col(text)).alias("size"), key.alias("_key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_tie")), "mix")
    n = rows.count()
    ranges = max(1, math.isqrt(n))
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), **how)
    # 1 - exp(-key) grows with the key and spreads keys of weight 1 evenly; rarer large keys share the last ranges
    rows = rows.withColumn("_range", F.least(F.lit(ranges - 1), F.floor((1 - F.exp(-F.col("_key"))) * ranges)).cast("int"))
    parts = rows.groupBy("source", "_range").agg(F.sum("size").alias("_part"))
    parts = parts.withColumn("_before", F.sum("_part").over(W.partitionBy("source").orderBy("_range")) - F.col("_part")).drop("_part")
    goals = goals.withColumnRenamed("source", "_s")
    parts = parts.join(goals, parts["source"].eqNullSafe(goals["_s"])).drop("_s").withColumnsRenamed({"source": "_s", "_range": "_r"})
    rows = rows.join(parts, rows["source"].eqNullSafe(parts["_s"]) & (rows["_range"] == parts["_r"])).drop("_s", "_r")
    run = F.col("_before") + F.sum("size").over(W.partitionBy("source", "_range").orderBy("_key", "doc_id", "_tie", *rid).rowsBetween(W.unboundedPreceding, 0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    # the document at the edge is taken if more than half of it fits
    more = F.when(run - F.col("size") / 2 <= rest, F.col("size")).otherwise(F.lit(0))
    return rows.withColumn("taken", (epochs * F.col("size") + F.when(rest > 0, more).otherwise(F.lit(0))).cast("long")).drop("_before", "_range", "_key", "_tie")


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with their columns, size, target and the words taken, told apart by row."""
    rows = with_row_id(docs)
    taken = mix(rows).filter("taken > 0").select(F.col("_rid").alias("_taken"), "size", "target", "taken")
    clash = [c for c in ("size", "target", "taken") if c in docs.columns]
    return rows.drop(*clash).join(taken, F.col("_rid") == F.col("_taken")).drop("_rid", "_taken")


SQL_OVER = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(length(coalesce(text, '')) AS DOUBLE) AS n,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS DOUBLE) AS symbols,
         (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM {docs}
), k AS (
  SELECT doc_id, source, text, size, -ln(u) / (CASE WHEN n = 0 THEN 1.0 ELSE greatest(0.1, (n - 10 * symbols) / n) END) AS key FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source
), sw AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS cap FROM s
), lv AS (
  SELECT *, ((SELECT sum(source_size) FROM s) * 150 / 100.0
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev,
         row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS rn
  FROM sw
), g AS (
  SELECT source, source_size, CAST(coalesce(least(cap, w * (SELECT arg_min(lev, rn) FROM lv WHERE lev * w < cap)), cap) AS DOUBLE) AS target FROM lv
), r AS (
  SELECT k.*, source_size, target,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS run,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source
), m AS (
  SELECT *, CAST(epochs * size + CASE WHEN target - epochs * source_size > 0 AND run - size / 2.0 <= target - epochs * source_size THEN size ELSE 0 END AS BIGINT) AS taken FROM r
)
"""
SQL = SQL_OVER.replace("{docs}", "documents") + "SELECT doc_id, size, source_size, target, taken FROM m"
