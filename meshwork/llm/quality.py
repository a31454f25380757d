"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a boolean expression that is true for a bad document. On a bounded sample each rule's cost is timed (its job
against one that only reads the texts, the least of several warm runs), and what all rules say of each sampled document is
counted. Rules are then chosen one by one by rejections per second among the documents that those before leave, and stand
in one CASE expression in that order, so a document that an early rule rejects never pays for the later ones. The order
changes the cost, never the verdict.

Repeated 3-word windows are found by sorting their hashes, packed with their places into longs; where two neighbours'
hashes agree but not their words, that text is judged by sorting the windows themselves.

Cases: a null or empty text has no words, fails the base rule and is not kept; repeated rows are judged alike; an empty
table gives an empty result; further columns pass through `quality_filter` untouched (columns named _q_* are its own).
"""

from __future__ import annotations

import time
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import WORD, materialize

#: Rows in the sample on which costs and selectivities are estimated, and runs of which the fastest counts.
SAMPLE_ROWS = 2000
RUNS = 3
SYMBOLS = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """The words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def repeated_by_words(words: Column) -> Column:
    """Places of 3-word windows that occur twice or more, by sorting the windows with their places."""
    n = F.size(words)
    windows = F.slice(F.arrays_zip(words.alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c"), F.sequence(F.lit(0), n - 1).alias("p")), 1, n - 2)
    ordered = F.sort_array(windows)
    pairs = F.arrays_zip(ordered.alias("x"), F.slice(ordered, 2, n).alias("y"))
    same = F.filter(pairs, lambda z: (z["x"]["b"] == z["y"]["b"]) & (z["x"]["a"] == z["y"]["a"]) & (z["x"]["c"] == z["y"]["c"]))
    return F.flatten(F.transform(same, lambda z: F.array(z["x"]["p"], z["y"]["p"])))


def with_repeated_words(df: DataFrame, words: str = "_q_words") -> DataFrame:
    """Adds n_repeat_words: words inside 3-word windows that occur twice or more in the text, the first included.

    Each step is a column of its own, so that what later steps use several times is computed once.
    """
    w, n, keys, bits = F.col(words), F.size(words), F.col("_q_keys"), F.col("_q_bits")
    shift = lambda f, x: F.call_function(f, x, bits)
    some = n >= 4
    key = lambda i: shift("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))).bitwiseOR(i.cast("long"))
    place = lambda i: F.get(keys, i).bitwiseAND(shift("shiftleft", F.lit(1).cast("long")) - 1).cast("int")
    hashed = lambda i: shift("shiftright", F.get(keys, i))
    differs = lambda i: F.exists(F.array(*map(F.lit, range(3))), lambda k: F.get(w, place(i) + k) != F.get(w, place(i + 1) + k))
    ints = "array<int>"
    df = df.withColumn("_q_bits", F.length(F.bin(n)))
    df = df.withColumn("_q_keys", F.when(some, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), key))))
    df = df.withColumn("_q_same", F.when(some, F.filter(F.sequence(F.lit(0), n - 4), lambda i: hashed(i) == hashed(i + 1))))
    by_hash = F.flatten(F.transform("_q_same", lambda i: F.array(place(i), place(i + 1))))
    found = F.when(F.exists("_q_same", differs), repeated_by_words(w).cast(ints)).otherwise(by_hash)
    df = df.withColumn("_q_starts", F.when(F.size("_q_same") > 0, F.sort_array(F.array_distinct(found))))
    starts = F.col("_q_starts")
    gaps = F.aggregate(F.sequence(F.lit(1), F.size(starts) - 1), F.lit(3), lambda a, k: a + F.least(F.lit(3), F.get(starts, k) - F.get(starts, k - 1)))
    n_repeat = F.when(F.size(starts) > 1, gaps).otherwise(F.lit(0)).cast("long")
    return df.withColumn("n_repeat_words", n_repeat).drop("_q_bits", "_q_keys", "_q_same", "_q_starts")


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumns({"_q_words": words_of(F.col(text)), "_q_lines": F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    words, lines = F.col("_q_words"), F.col("_q_lines")
    out = with_repeated_words(out).withColumns({"n_words": F.size(words).cast("long"), "word_chars": F.length(F.array_join(words, "")).cast("long"), "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"), "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")})
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("_q_words", "_q_lines")


@dataclass(frozen=True)
class Rule:
    """A name and an expression over the text column that is true where the document is to be rejected."""

    name: str
    rejects: Column


def default_rules(text: str = "text") -> list[Rule]:
    """Rules after the base ones; thresholds leave ordinary prose of any language alone."""
    whole = F.coalesce(F.col(text), F.lit(""))
    n = F.regexp_count(whole, F.lit(WORD))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    letters = F.regexp_count(whole, F.lit(r"\p{L}"))
    return [
        Rule("symbols", 5 * F.regexp_count(whole, F.lit(SYMBOLS)) > n),
        Rule("long_words", F.length(whole) > 40 * (n + 1)),
        Rule("few_letters", 2 * letters < F.length(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", ""))),
        Rule("repeated_lines", (F.size(lines) >= 4) & (2 * (F.size(lines) - F.size(F.array_distinct(lines))) > F.size(lines))),
    ]


@dataclass(frozen=True)
class Measured:
    """Seconds of each rule on the sample, and how many sampled documents each set of rules rejects together."""

    seconds: dict[str, float]
    verdicts: dict[frozenset[str], int]


def measure(df: DataFrame, text: str, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, runs: int = RUNS) -> Measured:
    """Costs and verdicts of rules on a sample of the first sample_rows rows, written to the shared folder."""
    sample = materialize(df.select(text).limit(sample_rows), "quality-sample")
    hits = {r.name: F.coalesce(r.rejects, F.lit(False)) for r in rules}

    def seconds(job: DataFrame) -> float:
        job.collect()  # compiles the code
        took = []
        for _ in range(runs):
            begun = time.perf_counter()
            job.collect()
            took.append(time.perf_counter() - begun)
        return min(took)

    reading = seconds(sample.agg(F.sum(F.length(text))))
    cost = {name: max(1e-4, seconds(sample.agg(F.count_if(hit))) - reading) for name, hit in hits.items()}
    sets = sample.groupBy(F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in hits.items()])).alias("by")).count()
    return Measured(cost, {frozenset(r["by"]): r["count"] for r in sets.collect()})


def order_rules(rules: list[Rule], m: Measured) -> list[Rule]:
    """At each step the rule with most rejections per second among what is left; ties by name."""
    left, verdicts, out = list(rules), Counter(m.verdicts), []
    while left:
        rejected = {r.name: sum(n for by, n in verdicts.items() if r.name in by) for r in left}
        best = min(left, key=lambda r: (-rejected[r.name] / m.seconds[r.name], m.seconds[r.name], r.name))
        out.append(best)
        left.remove(best)
        verdicts = Counter({by: n for by, n in verdicts.items() if best.name not in by})
    return out


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects the document, null if none does."""
    verdict = None
    for r in rules:
        hit = F.coalesce(r.rejects, F.lit(False))
        verdict = F.when(hit, F.lit(r.name)) if verdict is None else verdict.when(hit, F.lit(r.name))
    return verdict if verdict is not None else F.lit(None).cast("string")


def quality_filter(df: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """df with the base counts, base_failed, rejected_by and kept. The base rule comes first, as its counts are results
    for every document and so are paid for anyway; the cascade judges what it leaves."""
    rules = default_rules(text) if rules is None else rules
    ordered = order_rules(rules, measure(df, text, rules, sample_rows)) if len(rules) > 1 else rules
    out = base_counts(df, text)
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(ordered)))
    return out.withColumn("kept", F.col("rejected_by").isNull())


def query(docs: DataFrame) -> DataFrame:
    out = quality_filter(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents
), tri AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri) WHERE n > 1
), cov AS (
  SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) o(k) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, text,
         CAST(len(ln) AS BIGINT) AS n_lines,
         len(regexp_extract_all(text, '\p{L}')) AS letters
  FROM t LEFT JOIN cov USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 5 * n_symbols > n_words OR length(text) > 40 * (n_words + 1)
            OR 2 * letters < word_chars OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)) AS kept
FROM b
"""
