"""WARC: one gzip member per record, written through Spark's committed text writer and read back sequentially.

Archives are real concatenations of gzip members, so any WARC tool reads them. Spark's text source writes the bytes of
a string column followed by a separator; a member's last byte (the top byte of its length, zero below 16 MiB) serves as
that separator. A larger record gets an empty member behind it, which ends in a zero too. Writing this way needs no
local folder and keeps the commit protocol: a lost task leaves no half archive.

Cases: null html is an empty payload; null url leaves the target out; a null page_id stays null; rows that repeat the
smallest page_id of a payload are each a response; an empty table gives no archives and an empty result; records never
refer to themselves.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.common import collect_garbage, materialize, scratch_path

#: Payloads of fewer bytes are always stored whole.
LEAST = 100
DATE = "2024-01-01T00:00:00Z"
#: Bytes of payloads in an archive, if it isn't a single record's, and bytes of a payload in the lowest size class.
ARCHIVE = 1 << 28
SMALL = 1 << 16
#: Repeated payloads (a digest and an id each) that are broadcast at most, and parts of one payload's pages beyond.
BROADCAST = 1 << 18
PARTS = 16
CHUNK = 1 << 16
COLUMNS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    h = hashlib.sha256(f"{page_id}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member that ends in a zero byte."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    record = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    member = gzip_member(record)
    return member if member[-1] == 0 else member + gzip_member(b"")


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(archive: memoryview) -> Iterator[bytes]:
    """Contents of an archive's gzip members, decompressed piece by piece."""
    at = 0
    while at < len(archive):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(archive):
                raise ValueError("the archive ends within a member")
            piece = archive[at : at + CHUNK]
            parts.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
        yield b"".join(parts)


def decode_record(data: bytes) -> dict:
    """Headers, payload and lengths of one record, framed by its content length; both digests are checked."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    length = int(fields["Content-Length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("content length and record differ")
    if "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload digest differs")
    url = fields.get("WARC-Target-URI")
    url = url and url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("Page-Id"), "url": url, "record_type": fields["WARC-Type"], "refers_to": number("Refers-To-Page-Id"), "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload}


def size_class(size: Column) -> Column:
    """0 up to SMALL bytes, then one more each time the size doubles."""
    return F.when(size <= SMALL, 0).otherwise(F.ceil(F.log2(size / SMALL))).cast("int")


def write_warc(pages: DataFrame, path: str) -> None:
    """Writes pages (page_id, url, html) as WARC archives under path, each of at most some ARCHIVE bytes or one record.

    The first page of each payload is found from digests alone. These, for payloads that repeat, come back by a broadcast
    up to BROADCAST of them; beyond, the pages are shuffled to them, those of one payload in PARTS parts. Pages are
    written by size class, so that the number of records bounds an archive's bytes.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "size": F.octet_length("html")})
    by_digest = p.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("size").alias("size"), F.count("*").alias("n"))
    by_digest = materialize(by_digest.filter("n > 1").unionByName(p.groupBy(size_class(F.col("size")).alias("c")).agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("digest"), F.col("c").cast("long").alias("first"), F.lit(0).alias("size"), "n")), "digests")
    classes = sorted(r["first"] for r in by_digest.filter("digest is null").select("first").collect())  # some twenty at most
    first = by_digest.filter((F.col("size") >= LEAST) & F.col("first").isNotNull() & F.col("digest").isNotNull()).select(F.col("digest").alias("_d"), F.col("first"))
    if first.count() <= BROADCAST:
        joined = p.join(F.broadcast(first), F.col("digest") == F.col("_d"), "left")
    else:
        first = first.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        joined = p.join(first, (F.col("digest") == F.col("_d")) & (F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)) == F.col("_part")), "left")
    joined = joined.withColumn("refers_to", F.when(F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)), F.col("first")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            while at < b.num_rows:  # records of some 16 MB at a time
                out, held = [], 0
                while at < b.num_rows and held < 1 << 24:
                    r = b.slice(at, 1).to_pylist()[0]
                    out.append(encode_record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"])[:-1])
                    held += len(out[-1])
                    at += 1
                yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    for c in classes:
        own = joined.filter(size_class(F.col("size")) == c).select("page_id", "url", "html", "digest", "refers_to")
        # a cast from binary to string keeps the bytes as they are
        records = own.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value"))
        records.write.option("lineSep", "\0").option("maxRecordsPerFile", max(1, ARCHIVE // (SMALL << c))).text(f"{path}/{c}")
    if not classes:
        p.select("url").limit(0).write.text(f"{path}/0")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives under path. An archive, whose size the writer bounds, is read by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    schema = COLUMNS if payloads else COLUMNS.rpartition(",")[0]
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for data in members(memoryview(content.as_buffer())):
                    if not data:
                        continue
                    r = decode_record(data)
                    rows.append({x: r[x] for x in names})
                    held += len(data) if payloads else 0
                    if len(rows) >= 1024 or held > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.mapInArrow(decode, schema)


def query(pages: DataFrame) -> DataFrame:
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    collect_garbage(pages.sparkSession)
    return read_warc(pages.sparkSession, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
