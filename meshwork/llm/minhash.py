"""MinHash near-duplicate detection with tensored banding.

Two collections of `tables` small hashes are computed per document, each hash built from `width` minima of its shingle
set. Table keys are all pairs of one hash from each collection, so tables**2 keys cost only 2 * tables * width minima.
Documents that share a key are candidates; every candidate is verified on the full shingle sets, so no link is false.
At a similarity of 0.85 a pair shares no key with probability below 3e-4 (tables 7, width 2), at 0.9 below 3e-5; at 0.8
9 tables stay below 3e-4 (7 would miss 1.6e-3). op5 links at 0.85, the corpus pipeline at 0.8, as its caller says.

Steps: equal sets collapse to one representative. Members of a bucket are tied to its smallest id; what hangs together
by these ties is a group, and links stay within groups. Small groups are compared in full. A large group gets a core C,
the shingles that most of its members hold. A member x differs from the core in D(x) shingles, and two members differ
in |D(x)| + |D(y)| - 2 * |D(x) & D(y)|. So some pairs link for certain: of these the one with the member nearest to the
core does for components. For any other pair to link, D(x) & D(y) has to be large. Members that share a shingle which
few hold meet at that shingle. All others can only have common parts of D in common, which rules out nearly all pairs;
what is left of these meets within ties and, across components, within buckets. Large buckets are first cut by further
minima of the signature, which finds most links but not all (at 0.85 it misses 0.3% a level, at 0.8 1.4%); then the open
members of their groups meet by a prefix-filter join on the shingles of D, which misses none. So n near copies of one
text cost some n comparisons, whatever they differ in, and no bucket is capped. In all, a similar pair is missed if it
shares no key or if too few of its minima agree (1e-6), and for no other reason.

Cases: null and empty texts (or without words) have an empty set and link with nothing; fewer words than a shingle make
one shingle; repeated rows have equal sets; rows that share an id take part one by one and report by id; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import HOT, Prefix, ascii_lower, in_bucket, materialize, mix, text_pieces, with_row_id, word_hashes
from meshwork.llm.graph import components

SHINGLE = 5
#: Link at 100 * intersection >= LEAST * union.
LEAST = 85
TABLES = 7
WIDTH = 2
#: Groups of at most so many members are compared in full.
FEW = 6
#: A shingle that at most so many members of a group hold is a rarer one.
SMALL = 64
#: Buckets of at most so many open members are compared in full, by a join that yields what distances leave. Larger ones
#: are cut by GROUPS groups of three further minima, LEVELS times; then the members still open meet by what they share.
FULL = 512
GROUPS = 6
LEVELS = 3
#: At most so many ids (8 bytes each) are broadcast to pick texts; beyond, texts are shuffled to their ids.
IDS = 1 << 20
#: Of the signature's minima so many must agree before sets are compared; at 0.85 fewer agree with probability 1e-6.
AGREE = 12
#: Tables and agreement for links at 0.8, with the same probabilities.
AT_80 = {"least": 80, "tables": 9, "agree": 16}
_seeds = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 2 * 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of each text."""
    for _, _, buf, offsets in text_pieces(column):
        low = ascii_lower(buf)
        begin, _, words = word_hashes(low, offsets[:-1])
        first = np.searchsorted(begin, offsets)
        grams = Prefix(words).windows(SHINGLE)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= SHINGLE:
                yield np.unique(grams[a : b - SHINGLE + 1])
            elif b > a:
                yield Prefix(words[a:b]).spans(np.array([0]), np.array([b - a]))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    for i in range(n):
        x = shingles * _seeds[i]
        out[i] = (x ^ (x >> np.uint64(29))).min() if i % 2 else ((x + _seeds[i + 1]) ^ (x >> np.uint64(31))).min()
    return mix(out)


def signatures(docs: DataFrame, tables: int, width: int) -> DataFrame:
    """(_rid, doc_id, n_shingles, set_hash, a, b): a and b are the two collections of small hashes."""
    n = 2 * tables * width
    schema = pa.schema([("_rid", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("minima", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            size, digest, sigs = [], [], []
            for s in shingle_sets(batch.column("text")):
                size.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s, n) if len(s) else np.zeros(n, np.uint64))
            if not size:
                continue
            sig = np.stack(sigs)
            half = mix((sig.reshape(len(size), 2 * tables, width) * _seeds[:width]).sum(2)).view(np.int64)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("_rid"), batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), lists(half[:, :tables]), lists(half[:, tables:]), lists(sig.view(np.int64))], schema=schema)

    return docs.select("_rid", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "_rid long, doc_id long, n_shingles long, set_hash binary, a array<long>, b array<long>, minima array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(id, s): the full set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column("text"))]
            for at in range(0, len(sets), 512):
                part = sets[at : at + 512]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("_rid").slice(at, len(part)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(part)))], ["id", "s"])

    return docs.select("_rid", F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, s array<long>")


def agreement(x: Column, y: Column) -> Column:
    """How many of two signatures' minima agree."""
    return F.size(F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda z: z["x"] == z["y"]))


def verified(pairs: DataFrame, sets: DataFrame, least: int, agree: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    x = sets.select(F.col("id").alias("a"), F.col("s").alias("x"), F.col("minima").alias("mx"))
    y = sets.select(F.col("id").alias("b"), F.col("s").alias("y"), F.col("minima").alias("my"))
    small = pairs.join(x.select("a", "mx", F.size("x").alias("nx")), "a").join(y.select("b", "my", F.size("y").alias("ny")), "b")
    likely = small.filter((100 * F.least("nx", "ny") >= least * F.greatest("nx", "ny")) & (agreement(F.col("mx"), F.col("my")) >= agree)).select("a", "b")
    likely = materialize(likely, "likely")
    both = likely.join(x.select("a", "x"), "a").join(y.select("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.withColumn("_c", common).filter(100 * F.col("_c") >= least * (F.size("x") + F.size("y") - F.col("_c"))).select("a", "b")


def in_group(rows: DataFrame, groups: DataFrame, how: str = "inner", by: str = "id") -> DataFrame:
    """rows (g, size, ...) with their group's row in groups (_g, _size, ...); a large group's rows go in parts of HOT."""
    parts = lambda c: F.ceil(F.col(c) / HOT).cast("long")
    x = rows.withColumn("_salt", F.pmod(F.xxhash64(by), parts("size")))
    y = groups.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts("_size") - 1))).drop("_size")
    return x.join(y, (F.col("g") == F.col("_g")) & (F.col("_salt") == F.col("_part")), how).drop("_salt", "_part")


def bucket_pairs(keys: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's smallest id."""
    first = keys.groupBy(F.col("key").alias("_k")).agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return in_bucket(keys, "key", materialize(first, "buckets")).filter("id <> a").select("a", F.col("id").alias("b")).distinct()


def possible(least: int, h: str) -> Column:
    """Whether what a and b can have in common beside the core (ha, hb) makes up for their distances from it (fa, fb)."""
    return F.col("fa") + F.col("fb") <= 2 * (100 + least) * F.least(f"{h}a", f"{h}b")


def sides(stats: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
    """stats as the two sides of a pair: (cols, a, fa, ha, ka) and (_cols, b, fb, hb, kb)."""
    side = lambda s, mark: stats.select(*(F.col(c).alias(mark + c) for c in cols), F.col("id").alias(s), *(F.col(c).alias(c + s) for c in ("f", "h", "k")))
    return side("a", ""), side("b", "_")


def across(rows: DataFrame, least: int, agree: int) -> DataFrame:
    """Pairs of a bucket's members in different components that neither core nor signature rules out."""
    x, y = sides(rows, "key", "c", "minima")
    on = (F.col("key") == F.col("_key")) & (F.col("a") < F.col("b")) & (F.col("c") != F.col("_c")) & possible(least, "k") & (agreement(F.col("minima"), F.col("_minima")) >= agree)
    return x.join(y, on).select("a", "b").distinct()


def within_few(sets: DataFrame, agree: int) -> DataFrame:
    """All pairs of groups of FEW members at most that the signature doesn't rule out."""
    few = sets.filter(F.col("size") <= FEW)
    x, y = few.select("g", F.col("id").alias("a"), F.col("minima").alias("mx")), few.select(F.col("g").alias("_g"), F.col("id").alias("b"), F.col("minima").alias("my"))
    return x.join(y, (F.col("g") == F.col("_g")) & (F.col("a") < F.col("b")) & (agreement(F.col("mx"), F.col("my")) >= agree)).select("a", "b")


def core_distances(sets: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, g, size, f, h, k) of large groups' members, (id, key) of those that hold one of its rarer shingles, (_g, core).

    f is (100 + least) * |D| - (100 - least) * |s|, so a pair links for certain if its f sum to 0 or less. h counts the
    part of D that another member might share, k what is common of it: missing parts of the core, and shingles that more
    than SMALL members hold. Shingles are counted with a partial aggregation before the shuffle; a core has at most twice
    as many shingles as the mean set.
    """
    many = sets.filter(F.col("size") > FEW)
    each = many.select("g", "size", "id", F.explode("s").alias("x"))
    counted = each.groupBy("g", "x").agg(F.count("*").alias("df"), F.min("id").alias("one"), F.max("size").alias("size"), (2 * F.count("*") > F.max("size")).alias("core"))
    counted = materialize(counted.filter(f"core or df <= {SMALL}"), "counted")
    cores = counted.filter("core").groupBy(F.col("g").alias("_g")).agg(F.max("size").alias("_size"), F.collect_list("x").alias("core"))
    alone = counted.filter("df = 1").groupBy(F.col("one").alias("_i")).agg(F.count("*").alias("u"))
    rare = counted.filter("df > 1 and not core").select(F.col("g").alias("_g"), F.col("x").alias("_x"))
    rare = materialize(each.drop("size").join(rare, (F.col("g") == F.col("_g")) & (F.col("x") == F.col("_x"))).select("id", F.xxhash64("g", "x").alias("key")), "rare")
    held = rare.groupBy(F.col("id").alias("_r")).agg(F.count("*").alias("r"))
    size = F.coalesce(F.size("core"), F.lit(0)) + F.size("s") - 2 * F.when(F.col("core").isNull(), 0).otherwise(F.size(F.array_intersect("s", "core")))
    at = in_group(many, cores, "left").select("id", "g", "size", F.size("s").cast("long").alias("n"), size.cast("long").alias("d"))
    at = at.join(alone, F.col("id") == F.col("_i"), "left").join(held, F.col("id") == F.col("_r"), "left").withColumn("h", F.col("d") - F.coalesce("u", F.lit(0)))
    out = at.select("id", "g", "size", ((100 + least) * F.col("d") - (100 - least) * F.col("n")).alias("f"), "h", (F.col("h") - F.coalesce("r", F.lit(0))).alias("k"))
    return materialize(out, "distances"), rare, cores


def sharing(rare: DataFrame, stats: DataFrame, least: int) -> DataFrame:
    """Pairs that share a rarer shingle and that distances don't rule out."""
    x, y = sides(rare.join(stats.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i")), "key")
    return x.join(y, (F.col("key") == F.col("_key")) & (F.col("a") < F.col("b")) & possible(least, "h")).select("a", "b").distinct()


def still_open(placed: DataFrame, least: int) -> DataFrame:
    """Of placed (id, g, size, f, h, k, c) the members that may link to another component by common parts of D alone."""
    placed = placed.withColumn("r", F.col("f") - 2 * (100 + least) * F.col("k"))
    each = placed.groupBy("g", "c").agg(F.max("size").alias("size"), F.min("f").alias("f"), F.min("r").alias("r"))
    one = each.groupBy(F.col("g").alias("_g")).agg(F.max("size").alias("_size"), F.min(F.struct("f", "c")).alias("bf"), F.min(F.struct("r", "c")).alias("br"), F.count("*").alias("n")).filter("n > 1").drop("n")
    two = in_group(each, one, by="c").groupBy("_g").agg(F.max("size").alias("_size"), F.max("bf").alias("bf"), F.max("br").alias("br"), F.min(F.when(F.col("c") != F.col("bf.c"), F.col("f"))).alias("f2"), F.min(F.when(F.col("c") != F.col("br.c"), F.col("r"))).alias("r2"))
    x = in_group(placed, two)
    f, r = F.when(F.col("c") != F.col("bf.c"), F.col("bf.f")).otherwise(F.col("f2")), F.when(F.col("c") != F.col("br.c"), F.col("br.r")).otherwise(F.col("r2"))
    return x.filter((F.col("r") + f <= 0) & (F.col("f") + r <= 0)).select("id", "g", "size", "f", "h", "k", "c", f.alias("o"))


def sharing_differences(alive: DataFrame, sets: DataFrame, cores: DataFrame, least: int) -> DataFrame:
    """All pairs of open members (id, g, f, c, o) in different components that have enough of D in common to link.

    Of D(x) only what another component holds too counts, m shingles in order of their number of holders. As o is the
    least f in other components, x needs (f + o) / (2 * (100 + least)) of them in common with any y, so the first one in
    common is among the first m - need + 1 of both, and what follows it in either list bounds what is in common. A
    shingle's holders meet in pairs of blocks of some FULL / 2, so that a frequent one is shared among tasks.
    """
    core = F.coalesce("core", F.array().cast("array<bigint>"))
    own = alive.select("id", "g", "size", "f", "c", "o").join(sets.select(F.col("id").alias("_i"), "s"), F.col("id") == F.col("_i"))
    each = in_group(own, cores, "left").select("id", "g", "f", "c", "o", F.explode(F.concat(F.array_except("s", core), F.array_except(core, "s"))).alias("t"))
    each = materialize(each, "differences")
    held = each.groupBy(F.col("g").alias("_g"), F.col("t").alias("_t")).agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").drop("lo", "hi")
    lists = each.join(held, (F.col("g") == F.col("_g")) & (F.col("t") == F.col("_t"))).groupBy("id", "g", "f", "c", "o").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("l"))
    need = F.greatest(F.lit(1), F.ceil((F.col("f") + F.col("o")) / (2 * (100 + least))).cast("int"))
    lists = lists.withColumn("m", F.size("l")).withColumn("first", F.col("m") - need + 1).filter("first > 0")
    rows = lists.select("id", "g", "f", "c", "m", F.posexplode(F.slice("l", F.lit(1), F.col("first"))).alias("p", "x"))
    rows = materialize(rows.select("id", "f", "c", (F.col("m") - F.col("p")).alias("rest"), F.xxhash64("g", "x.t").alias("key")), "prefixes")
    held = rows.groupBy(F.col("key").alias("_k")).agg(F.ceil(F.count("*") * 2 / FULL).alias("blocks"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi")
    rows = rows.join(held, F.col("key") == F.col("_k")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meet = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    side = lambda s, mark: rows.select(meet.alias(mark + "at"), F.col("id").alias(s), *(F.col(c).alias(c + s) for c in ("f", "c", "rest", "block", "other")))
    x, y = side("a", ""), side("b", "_")
    once = (F.col("blocka") != F.col("blockb")) | (F.col("blocka") == F.col("othera"))
    enough = F.col("fa") + F.col("fb") <= 2 * (100 + least) * F.least("resta", "restb")
    return x.join(y, (F.col("at") == F.col("_at")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & once & enough).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, least: int = LEAST, tables: int = TABLES, width: int = WIDTH, agree: int = AGREE) -> DataFrame:
    """(_rid, doc_id, n_shingles, component_id) for docs (doc_id, text)."""
    rows = docs.select("doc_id", "text", "_rid") if "_rid" in docs.columns else with_row_id(docs.select("doc_id", "text"))
    signed = materialize(signatures(rows, tables, width), "signatures")
    reps = signed.filter("set_hash is not null").groupBy("set_hash").agg(F.min("_rid").alias("rep"))
    reps = materialize(reps, "representatives")
    own = signed.join(reps.select(F.col("rep").alias("_rid")), "_rid").select(F.col("_rid").alias("id"), "a", "b", "minima")
    keyed = lambda x, *cols: x.select("id", *cols, "b", F.posexplode("a").alias("i", "x")).select("id", *cols, "i", "x", F.posexplode("b").alias("j", "y")).select("id", *cols, F.xxhash64("i", "x", "j", "y").alias("key"))
    pairs = materialize(bucket_pairs(keyed(own)), "pairs")
    # only members of buckets with others can link; their sets are computed once, the signature beside them
    group = materialize(components(pairs).withColumnsRenamed({"id": "_i", "component_id": "g"}), "groups")
    sizes = materialize(group.groupBy(F.col("g").alias("_k")).agg(F.count("*").alias("n")), "sizes")
    group = in_bucket(group.withColumnRenamed("_i", "id"), "g", sizes).withColumnsRenamed({"id": "_i", "n": "size"})
    member = materialize(own.join(group, F.col("id") == F.col("_i")).drop("_i"), "members")
    ids = member.select(F.col("id").alias("_i"))
    texts = rows.join(F.broadcast(ids) if ids.count() <= IDS else ids, F.col("_rid") == F.col("_i"), "left_semi").select("_rid", "text")
    sets = materialize(full_sets(texts).join(member.select("id", "g", "size", "minima"), "id"), "sets")
    stats, rare, cores = core_distances(sets, least)
    best = stats.groupBy(F.col("g").alias("_g")).agg(F.max("size").alias("_size"), F.min(F.struct("f", "id")).alias("b"))
    sure = in_group(stats, best).filter("f + b.f <= 0 and id <> b.id").select(F.col("b.id").alias("a"), F.col("id").alias("b"))
    x, y = sides(stats)
    tied = pairs.join(x, "a").join(y, "b").filter(F.col("fa") + F.col("fb") > 0).filter(possible(least, "k")).select("a", "b")
    near = [materialize(x, "near") for x in (within_few(sets, agree), tied, sharing(rare, stats, least))]
    near = reduce(DataFrame.unionByName, near).distinct()
    links = [materialize(sure, "sure"), materialize(verified(near, sets, least, agree), "verified")]

    def labels() -> DataFrame:
        return materialize(components(reduce(DataFrame.unionByName, links)), "components")

    def placed(x: DataFrame) -> DataFrame:
        """x (id, ...) with the component c."""
        return x.join(label.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i"), "left").withColumn("c", F.coalesce("component_id", "id")).drop("_i", "component_id")

    def mixed(x: DataFrame) -> DataFrame:
        """Rows (key, c, ...) of buckets that hold several components, with the bucket's size."""
        s = x.groupBy(F.col("key").alias("_k")).agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("_k", "n")
        return in_bucket(x, "key", materialize(s, "buckets"))

    label = labels()
    alive = materialize(still_open(materialize(placed(stats), "placed"), least).drop("o"), "open")
    # where few are left of a group, the group itself serves as their bucket
    left = alive.groupBy(F.col("g").alias("_g")).agg(F.max("size").alias("_size"), F.count("*").alias("left"))
    alive = in_group(alive, left).drop("_g").withColumnRenamed("id", "_i")
    alive = materialize(member.drop("g", "size").join(alive, F.col("id") == F.col("_i")).drop("_i"), "alive")
    cols = ("g", "size", "minima", "f", "h", "k", "c")
    keys = alive.filter(F.col("left") <= FULL).select("id", *cols, F.xxhash64("g").alias("key"))
    rest = materialize(mixed(keys.unionByName(keyed(alive.filter(F.col("left") > FULL), *cols))), "mixed")
    torn = materialize(rest.filter(F.col("n") > FULL).groupBy(F.col("g").alias("_t")).agg(F.max("size").alias("size")), "torn")
    for level in range(LEVELS):
        if rest.isEmpty():
            break
        near = across(rest.filter(F.col("n") <= FULL), least, agree)
        large = rest.filter(F.col("n") > FULL)
        # most similar pairs agree on one of the groups of minima, in one of all their buckets
        groups = [[(level + g + k * GROUPS) % (2 * tables * width) for k in range(3)] for g in range(GROUPS)]
        parts = F.array(*[F.xxhash64("key", F.lit(level), F.lit(g), *[F.col("minima")[x] for x in group]) for g, group in enumerate(groups)])
        cut = materialize(large.select("id", "minima", "f", "h", "k", F.explode(parts).alias("key")), "cut")
        found = materialize(verified(near.unionByName(bucket_pairs(cut.select("id", "key"))).distinct(), sets, least, agree), "verified")
        if not found.isEmpty():
            links.append(found)
            label = labels()
        rest = materialize(mixed(placed(cut)), "mixed")
    if not torn.isEmpty():
        # what the cuts have left, or torn apart
        torn = torn.withColumnsRenamed({"_t": "_g", "size": "_size"})
        alive = materialize(in_group(still_open(materialize(placed(stats), "placed"), least), torn).drop("_g"), "open")
        found = materialize(verified(sharing_differences(alive, sets, cores, least), sets, least, agree), "verified")
        if not found.isEmpty():
            links.append(found)
            label = labels()
    rep = reps.join(label, F.col("rep") == F.col("id"), "left").select(F.col("set_hash").alias("_h"), F.coalesce("component_id", "rep").alias("_c"))
    out = signed.select("_rid", "doc_id", "n_shingles", "set_hash").join(rep, F.col("set_hash") == F.col("_h"), "left")
    return out.select("_rid", "doc_id", "n_shingles", F.coalesce("_c", "_rid").alias("component_rid"))


def query(docs: DataFrame) -> DataFrame:
    """One row per row of docs; ids that are unique are their own row ids."""
    out = near_duplicates(docs)
    out = out.select("_rid", "doc_id", "n_shingles", F.col("component_rid").alias("_c"), (F.col("_rid") == F.col("component_rid")).alias("kept"))
    if out.filter("doc_id is null or doc_id <> _rid").isEmpty():
        return out.select("doc_id", "n_shingles", F.col("_c").alias("component_id"), "kept")
    ids = out.filter("kept").select(F.col("_rid").alias("_r"), F.col("doc_id").alias("component_id"))
    return out.join(ids, F.col("_c") == F.col("_r"), "left").select("doc_id", "n_shingles", "component_id", "kept")


def keep_first(docs: DataFrame, least: int = LEAST, tables: int = TABLES, width: int = WIDTH, agree: int = AGREE) -> DataFrame:
    """docs' rows with the smallest row id of their components. Rows that can't link all stay."""
    rows = with_row_id(docs)
    first = near_duplicates(rows, least, tables, width, agree).filter("_rid = component_rid").select(F.col("_rid").alias("_first"))
    return rows.join(first, F.col("_rid") == F.col("_first"), "left_semi").drop("_rid")
