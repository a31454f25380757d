"""Full-text search, vector search and rank fusion."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions import text_search, vectors
from meshwork.plans.lineage import partition_places, partition_starts, written

METRICS: dict[str, tuple[Callable[[Column, Column], Column], bool]] = {
    "cosine": (vectors.FUNCTIONS["cosine_similarity"], True),
    "dot": (vectors.FUNCTIONS["dot_product"], True),
    "euclidean": (vectors.FUNCTIONS["euclidean_distance"], False),
    "l2": (vectors.FUNCTIONS["l2_distance"], False),
    "l1": (vectors.lenient(vectors.manhattan), False),
}


def postings(docs: DataFrame, key: str, text: str, stemmed: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, len), terms (term, df) and postings (doc_id, term, tf) of a text column."""
    words = docs.select(F.col(key).alias("doc_id"), F.explode(text_search.tokens(F.col(text))).alias("word"))
    term = text_search.stem(F.col("word")) if stemmed else F.col("word")
    words = words.select("doc_id", term.alias("term")).filter(~F.col("term").isin(*text_search.STOP_WORDS))
    post = words.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return post.groupBy("doc_id").agg(F.sum("tf").alias("len")), post.groupBy("term").agg(F.count("*").alias("df")), post


def query_terms(spark: SparkSession, query: str, stemmed: bool = True) -> DataFrame:
    """(term): the distinct terms of a query."""
    words = spark.range(1).select(F.explode(text_search.tokens(F.lit(query))).alias("word"))
    term = text_search.stem(F.col("word")) if stemmed else F.col("word")
    return words.select(term.alias("term")).filter(~F.col("term").isin(*text_search.STOP_WORDS)).distinct()


def bm25(index: tuple[DataFrame, DataFrame, DataFrame], query: str, k1: float = 1.5, b: float = 0.0, stemmed: bool = True) -> DataFrame:
    """(doc_id, score). b weighs length normalisation; the query path's default leaves it out."""
    lengths, terms, post = index
    hit = post.join(query_terms(post.sparkSession, query, stemmed), "term")
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg")).first()
    n, mean = stats["n"], stats["avg"] or 1.0
    idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    found = hit.join(terms, "term")
    if b:
        found = found.join(lengths, "doc_id")
    norm = 1 - b + (b * F.col("len") / mean if b else F.lit(0.0))
    return found.groupBy("doc_id").agg(F.sum(idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)).alias("score"))


def bm25_scan(docs: DataFrame, key: str, text: str, query: str, k1: float = 1.5, b: float = 0.0, stemmed: bool = True) -> DataFrame:
    """bm25 of one query over texts without an index: (doc_id, score), as bm25 of their postings gives them.

    Stems are taken of the distinct words only; those of the query's terms and of stop words, a few forms each, go back
    into a scan that counts them inside each text. No row is made for a word.
    """
    words = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), text_search.tokens(F.col(text)).alias("words"))
    wanted = sorted(r["term"] for r in query_terms(docs.sparkSession, query, stemmed).collect())
    forms = {t: [t] for t in [*wanted, *text_search.STOP_WORDS]}
    if stemmed:
        distinct = words.select(F.explode("words").alias("word")).distinct()
        # stems take longer than the few bytes of a vocabulary let on
        distinct = distinct.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism)
        stems = distinct.select("word", text_search.stem(F.col("word")).alias("term"))
        forms = {t: [] for t in forms}
        for r in stems.filter(F.col("term").isin(*forms)).collect():
            forms[r["term"]].append(r["word"])
    skipped = [w for t in text_search.STOP_WORDS for w in forms[t]]
    left = F.filter("words", lambda w: ~w.isin(*skipped)) if skipped else F.col("words")
    length = F.size(left) if b else F.exists("words", lambda w: ~w.isin(*skipped)).cast("int") if skipped else (F.size("words") > 0).cast("int")
    count = lambda found: F.size(F.filter("words", lambda w: w.isin(*found))) if found else F.lit(0)
    found = words.select("doc_id", length.alias("len"), *(count(forms[t]).alias(f"tf_{i}") for i, t in enumerate(wanted)))
    tf = [f"tf_{i}" for i in range(len(wanted))]
    found = written(found.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ["len", *tf])).filter("len > 0"))
    stats = found.agg(F.count("*"), F.avg("len"), *(F.count_if(F.col(c) > 0) for c in tf)).first()
    n, mean = stats[0], stats[1] or 1.0
    norm = 1 - b + (b * F.col("len") / mean if b else F.lit(0.0))
    score = F.lit(0.0)
    for c, df in zip(tf, stats[2:], strict=True):
        score += F.log(F.lit((n - df + 0.5) / (df + 0.5) + 1)) * F.col(c) * (k1 + 1) / (F.col(c) + k1 * norm)
    return found.filter(" OR ".join(f"{c} > 0" for c in tf) or "false").select("doc_id", score.alias("score"))


def tf_idf(index: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """(doc_id, term, score): tf * ln(N / df)."""
    lengths, terms, post = index
    n = lengths.count()
    return post.join(terms, "term").select("doc_id", "term", (F.col("tf") * F.log(F.lit(float(n)) / F.col("df"))).alias("score"))


def vector_scores(df: DataFrame, column: str, query: list[float], metric: str = "cosine") -> DataFrame:
    f, _ = METRICS[metric]
    return df.withColumn("score", f(F.col(column), F.array(*map(F.lit, map(float, query)))))


def vector_top(df: DataFrame, key: str, column: str, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """(id, score) of the k nearest rows, exactly: a score per row and a top-k that keeps k rows per task."""
    best = F.desc("score") if METRICS[metric][1] else F.asc("score")
    return vector_scores(df.filter(F.col(column).isNotNull()), column, query, metric).select(F.col(key).alias("id"), "score").orderBy(best, "id").limit(k)


def ranked(df: DataFrame, key: str = "id", score: str = "score") -> DataFrame:
    """(id, rank) from 1, best first. The list is range-partitioned; a row's rank is its place in its range plus the sizes
    of the ranges before, so no task holds the whole list."""
    best = df.select(F.col(key).alias("id"), F.col(score).alias("_s")).orderBy(F.desc("_s"), "id")
    placed = written(best.select("id", *partition_places()))
    return placed.join(F.broadcast(partition_starts(placed)), "_part").select("id", (F.col("_start") + F.col("_place") + 1).alias("rank"))


def fuse(lists: list[DataFrame], weights: list[float] | None = None, k: float = 60.0, limit: int | None = None) -> DataFrame:
    """(id, score): reciprocal rank fusion of lists (id, rank)."""
    weights = weights or [1.0] * len(lists)
    each = [x.select("id", (F.lit(float(w)) / (k + F.col("rank"))).alias("s")) for x, w in zip(lists, weights, strict=True)]
    out = reduce(DataFrame.unionByName, each).groupBy("id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "id")
    return out if limit is None else out.limit(limit)


def hybrid(vector_list: DataFrame, text_list: DataFrame, k: float = 60.0, limit: int = 10) -> DataFrame:
    """Fusion of a vector search and a text search, each (id, score), best first."""
    return fuse([ranked(vector_list), ranked(text_list)], None, k, limit)


def multi_perspective(searches: list[DataFrame], k: float = 60.0, limit: int = 10) -> DataFrame:
    """Fusion of several searches (id, score) for one need."""
    return fuse([ranked(x) for x in searches], None, k, limit)


def rerank(df: DataFrame, cosine: str = "similarity", age: str = "age_days", uses: str = "uses", graph: str = "graph_score", limit: int | None = None) -> DataFrame:
    """Adds `score`: similarity, recency, frequency and graph proximity, weighted .6, .15, .1 and .15."""
    score = 0.6 * (F.col(cosine) + 1) / 2 + 0.15 * F.exp(-0.01 * F.col(age)) + 0.1 * F.log(F.col(uses) + 1) / F.log(F.lit(1000.0)) + 0.15 * F.least(F.greatest(F.col(graph), F.lit(0.0)), F.lit(1.0))
    out = df.withColumn("score", score)
    return out if limit is None else out.orderBy(F.desc("score")).limit(limit)
