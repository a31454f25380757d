"""Shared pieces of the training-data operators: scratch tables, row ids, vectorised token hashing."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised pass looks at together; longer documents go in pieces.
PIECE = 1 << 20
#: Jobs of fewer seconds leave their shuffle files to the next longer one.
BRIEF = 1.0
#: Groups, buckets and hubs of more rows are dealt to several tasks: groups in parts of HOT, the others in PARTS parts.
HOT = 256
PARTS = 64
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only a local master without that setting gets a folder of its own (tests); on a cluster its absence is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _local_dirs:
        _local_dirs[key] = "file://" + tempfile.mkdtemp(prefix="meshwork-")
    return _local_dirs[key]


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through Hadoop's file system; a stopped session is left alone."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit; scratch files are then left to the folder's owner
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(delete_path, spark, path)
    return path


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of finished jobs now rather than at the driver's next collection.

    The first round frees Python's handles on the JVM's plans, the second what only these plans held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)
    trim_native_heap(spark)


def trim_native_heap(spark: SparkSession) -> str | None:
    """Lets the driver's JVM return native memory that its threads have freed, which glibc else keeps for later use.

    Gives what the JVM says of it; None if that JVM has no such command (it came with 17.0.9, for Linux).
    """
    gateway = spark.sparkContext._gateway
    java = gateway.jvm.java.lang
    kinds, args = gateway.new_array(java.Class, 4), gateway.new_array(java.Object, 4)
    for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = java.Class.forName(kind)
    args[0], args[1] = gateway.jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:  # by the interface's method, as the server's own class isn't open to Py4J
        return java.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(java.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        return None


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and survives lost executors."""
    spark, path, schema = df.sparkSession, scratch_path(df.sparkSession, name), df.schema
    begun = time.perf_counter()
    df.write.parquet(path)
    del df
    if time.perf_counter() - begun > BRIEF:
        collect_garbage(spark)
    return spark.read.schema(schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def with_row_id(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds _rid, a long that is unique and ordered as (doc_id, text), nulls first.

    Unique non-null ids serve as they are. Where ids repeat or are null, rows are range-partitioned by (doc_id, text) and
    numbered by partition and place, in the JVM, so equal rows count as separate documents in an arbitrary order, which
    the written result fixes. Their places in the input break ties, so rows that are alike spread over partitions.
    """
    bad = df.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if bad.isEmpty():
        return df.withColumn("_rid", F.col("doc_id").cast("long"))
    placed = df.withColumn("_at", F.monotonically_increasing_id())
    ordered = placed.orderBy(F.col("doc_id").asc_nulls_first(), F.col(text).asc_nulls_first(), "_at").drop("_at")
    return materialize(ordered.withColumn("_rid", F.monotonically_increasing_id()), "rows")


def in_bucket(rows: DataFrame, key: str, buckets: DataFrame, by: str = "id") -> DataFrame:
    """rows (key, by, ...) with their bucket's row in buckets (_k, n, ...), where there is one. As rows don't know how
    large their bucket is, those of large ones are found first, with each of these in PARTS parts by another column."""
    large = buckets.filter(F.col("n") > HOT)
    if large.isEmpty():
        return rows.join(buckets, F.col(key) == F.col("_k")).drop("_k")
    cols = [c for c in buckets.columns if c != "_k"]
    parts = large.select("_k", *cols, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    x = rows.join(parts, (F.col(key) == F.col("_k")) & (F.pmod(F.xxhash64(by), F.lit(PARTS)) == F.col("_part")), "left").drop("_part")
    rest = x.filter("_k is null").drop("_k", *cols).join(buckets.filter(F.col("n") <= HOT), F.col(key) == F.col("_k"))
    return x.filter("_k is not null").drop("_k").unionByName(rest.drop("_k"))


# ---- vectorised hashing ------------------------------------------------------------------------------------------

_MUL = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_CHECK = np.random.Generator(np.random.PCG64(20240608)).integers(0, 2**64, 256, dtype=np.uint64)
_is_space = np.zeros(256, bool)
_is_space[[32, 9, 10, 11, 12, 13]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that nearby sums give unrelated hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0..n-1 modulo 2**64, and their inverses."""
    if len(_powers["p"]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(int(_MUL), -1, 2**64)
        for key, base in (("p", int(_MUL)), ("i", inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["p"][:n], _powers["i"][:n]


class Prefix:
    """Polynomial prefix sums over a sequence of 64-bit values: hashes of any span in constant time."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        p, self.inverse = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * p[:-1], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + length * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all spans of k values."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[: self.n - k + 1])


def word_bounds(buf: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of the words in buf; a word also ends where a document (at starts) begins."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_is_space[buf]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    if starts is not None:
        at = starts[(starts > 0) & (starts < len(buf))]
        begin[at] |= inside[at]
        end[at - 1] |= inside[at - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def word_hashes(buf: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds and 64-bit hashes of the words of buf, which holds whole documents that begin at starts."""
    begin, end = word_bounds(buf, starts)
    if len(buf) <= 4 * PIECE:
        return begin, end, Prefix(_BYTES[buf]).spans(begin, end)
    out, at = [], 0
    while at < len(begin):  # one long document: its words in pieces
        upto = max(at + 1, int(np.searchsorted(end, begin[at] + 2 * PIECE)))
        lo = begin[at]
        out.append(Prefix(_BYTES[buf[lo : end[upto - 1]]]).spans(begin[at:upto] - lo, end[at:upto] - lo))
        at = upto
    return begin, end, np.concatenate(out) if out else np.zeros(0, np.uint64)


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTES[buf]


def check_values(values: np.ndarray) -> np.ndarray:
    """Other values for the same sequence, so that hashes of both together have 128 bits."""
    return _CHECK[values] if values.dtype == np.uint8 else mix(values ^ _CHECK[0])


def ascii_lower(buf: np.ndarray) -> np.ndarray:
    return _lower[buf]


def text_pieces(column: pa.Array, limit: int = 2 * PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole documents of a string column in runs of about limit bytes: (first row, end row, bytes, offsets within)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    n = len(column)
    if not n:
        return
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        upto = min(upto, n)
        yield at, upto, data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto


def window_segments(values: np.ndarray, bounds: np.ndarray, length: int, k: int, other: np.ndarray) -> dict[str, np.ndarray]:
    """Winnows windows of `length` values: consecutive windows of a document that share their minimizer form a segment.

    values are the documents' values in a row, bounds their offsets. A window's minimizer is the leftmost of its
    k-grams with the smallest hash (by the upper 40 bits), so it depends on the window's content alone: equal windows
    have the same minimizer at the same place. Gives for each segment its document, first window (from the document's
    start), number of windows, minimizer hash, and two hashes of all it covers, from `values` and from `other`, the first
    together with the minimizer's place.
    """
    empty = {x: np.zeros(0, np.int64) for x in ("doc", "first", "count", "anchor", "hash", "check")}
    n, w = len(values), length - k + 1
    if n < length:
        return empty
    prefix = Prefix(values)
    grams = prefix.windows(k)
    low = np.uint64((1 << 24) - 1)
    if n > int(low):
        raise ValueError("a piece is limited to 2**24 values")
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    starts = n - length + 1
    least = np.minimum(least[:starts], least[w - size : w - size + starts])
    at = (least & low).astype(np.int64)
    doc = np.searchsorted(bounds, np.arange(starts), "right") - 1
    valid = np.arange(starts) + length <= bounds[doc + 1]
    head = valid.copy()
    head[1:] &= (at[1:] != at[:-1]) | ~valid[:-1] | (doc[1:] != doc[:-1])
    first = np.flatnonzero(head)
    if not len(first):
        return empty
    tail = valid.copy()
    tail[:-1] &= (at[1:] != at[:-1]) | ~valid[1:] | (doc[1:] != doc[:-1])
    last = np.flatnonzero(tail)
    anchor = grams[at[first]]
    place = at[first] - first
    whole = prefix.spans(first, last + length)
    return {"doc": doc[first], "first": first - bounds[doc[first]], "count": last - first + 1, "anchor": anchor.view(np.int64), "hash": mix(whole ^ (place.astype(np.uint64) * _MUL)).view(np.int64), "check": Prefix(other).spans(first, last + length).view(np.int64)}


def split_long(bounds: np.ndarray, length: int, most: int) -> list[tuple[int, int]]:
    """Pieces (start, end) of one document's values so that every window lies wholly in exactly one piece."""
    n = int(bounds[-1])
    return [(a, min(n, a + most + length - 1)) for a in range(0, max(1, n - length + 1), most)]


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal runs, in order."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return start[at], np.append(reach[at[1:] - 1], reach[-1])
