"""WARC archives by a chunked record table.

Payloads become rows of (record identifier, chunk number, chunk). A task slides over the bytes of a payload where they
lie in the Arrow batch: digests are carried from chunk to chunk, and chunks are given out a few at a time, so besides the
source row no whole payload is ever built. Each chunk is a WARC record of its own, and the chunks of one payload are a
segmented record (WARC-Segment-Number, continuation records). Spark's text writer makes the archives: a row is a record,
the line separator its end. An archive holds the records of one task, gzipped as usual; archives are read in parallel,
each as a stream that is split at the first header lines.
Chunks are cut so that none holds that line. SHA-1 digests of segmented payloads are carried from chunk to chunk
over rows sorted by record and number; a record that fits one chunk is digested where it is read.

Equal payloads of at least min_revisit bytes (told by SHA-256) are stored once, in the record with the largest page id;
the others become revisit records that refer to it.

Defined cases: a null html is an empty payload; a null url is an empty target; page ids are whole numbers, null ones come
before all others, and a revisit of a record with a null id refers to null; repeated rows are records of their own. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_key, read, saved, scratch_dir

FIRST, CRLF = "WARC/1.0\r\n", "\r\n"
CHUNK_BYTES = 65536
#: Bytes of chunks that a task gives out at once.
HELD_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
HEADER = re.compile(rb"WARC/1\.0\r\n")
RECORDS = "rid long, page_id long, url string, digest binary, sha binary, total long, number int, last boolean, chunk string"


def cuts(data: memoryview, chunk_bytes: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of the chunks of UTF-8 bytes: of at most chunk_bytes, of whole characters, none with a first header line."""
    marks = (m.start() + 2 for m in HEADER.finditer(data))
    at, mark, size = 0, next(marks, len(data)), len(data)
    while at < size or not size:
        end = min(at + chunk_bytes, mark)
        while end < size and data[end] & 0xC0 == 0x80:
            end -= 1
        yield at, end
        if end == mark:
            mark = next(marks, size)
        at = end
        if not size:
            return


def chunker(chunk_bytes: int):
    names = ["rid", "page_id", "url", "digest", "sha", "total", "number", "last", "chunk"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            rows.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in batches:
            for rid, page, url, html in zip(*batch.columns, strict=True):
                data = memoryview(html.as_buffer() or b"").cast("B")
                one, two, size = hashlib.sha1(), hashlib.sha256(), len(data)
                for at in range(0, size, HELD_BYTES):
                    part = data[at : at + HELD_BYTES]
                    one.update(part)
                    two.update(part)
                own = (rid.as_py(), page.as_py(), url.as_py(), one.digest(), two.digest(), size)
                for number, (at, end) in enumerate(cuts(data, chunk_bytes), 1):
                    rows.append((*own, number, end == size, bytes(data[at:end])))
                    if (held := held + end - at) > HELD_BYTES:
                        yield out()
                        held = 0
        yield out()

    return run


def record_table(pages: DataFrame, *, chunk_bytes: int = CHUNK_BYTES, min_revisit: int = 1000) -> DataFrame:
    """rid, page_id, url, digest, refers (rid), number (from 1), last, total (bytes), chunk."""
    own = pages.select(F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = saved(own.mapInArrow(chunker(chunk_bytes), RECORDS))
    index = saved(rows.where((F.col("number") == 1) & (F.col("total") >= min_revisit)).select("rid", "page_id", "sha"))
    order = F.struct(F.col("page_id").isNotNull(), "page_id", -F.col("rid"))
    groups = index.groupBy("sha").agg(F.max_by(F.col("rid"), order).alias("refers"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = saved(join_by_key(index.select("rid", "sha"), groups, "sha").where("rid <> refers").select("rid", "refers"))
    rows = rows.join(again, "rid", "left").where("refers IS NULL OR number = 1")
    stored = F.col("refers").isNull()
    return rows.select("rid", "page_id", "url", "digest", "refers", "total", "number", (F.col("last") | ~stored).alias("last"), F.when(stored, F.col("chunk")).otherwise("").alias("chunk"))


def write_archives(records: DataFrame, path: str, *, date: str = DATE, compression: str = "gzip") -> None:
    """Write the rows of record_table as WARC files below path. compression: gzip, or none for files that are read in splits."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    name = lambda rid, number: F.concat(F.lit("<urn:record:"), rid.cast("string"), F.lit(":"), number.cast("string"), F.lit(">"))
    c = F.col
    segmented = ~(c("last") & (c("number") == 1))
    kind = F.when(c("refers").isNotNull(), "revisit").when(c("number") == 1, "response").otherwise("continuation")
    head = F.concat(
        F.lit(FIRST), line("WARC-Type", kind), line("WARC-Record-ID", name(c("rid"), c("number"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.replace(F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))),
        line("X-Page-ID", F.coalesce(c("page_id").cast("string"), F.lit("-"))),
        F.when(c("number") == 1, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.lower(F.hex("digest"))))).otherwise(""),
        F.when(c("refers").isNotNull(), line("WARC-Refers-To", name(c("refers"), F.lit(1)))).otherwise(""),
        F.when(segmented, line("WARC-Segment-Number", c("number").cast("string"))).otherwise(""),
        F.when(c("number") > 1, line("WARC-Segment-Origin-ID", name(c("rid"), F.lit(1)))).otherwise(""),
        F.when(segmented & c("last"), line("WARC-Segment-Total-Length", c("total").cast("string"))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.octet_length("chunk").cast("string")), F.lit(CRLF), c("chunk"),
    )
    records.select(head.alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """rid, page_id, type, refers (rid), digest (as the header has it), segmented, number, total, content (bytes): a row for each record."""
    raw = spark.read.option("lineSep", CRLF * 2 + FIRST).text(path)
    # The head is short; the first record of a file still has its first line.
    parts = raw.select(F.expr("substring(value, 1, instr(value, '\\r\\n\\r\\n') + 1)").alias("head"), F.expr("encode(value, 'UTF-8')").alias("all"))
    field = lambda n, pattern=r"([^\r]*)": F.nullif(F.regexp_extract("head", rf"(?:^|\r\n){n}: {pattern}", 1), F.lit(""))
    rid = lambda n: field(n, r"<urn:record:(\d+):").cast("long")
    content = F.expr("substring(all, octet_length(head) + 3, int(size))")
    parts = parts.withColumn("size", field("Content-Length").cast("long"))
    return parts.select(
        F.coalesce(rid("WARC-Segment-Origin-ID"), rid("WARC-Record-ID")).alias("rid"), F.nullif(field("X-Page-ID"), F.lit("-")).cast("long").alias("page_id"), field("WARC-Type").alias("type"),
        rid("WARC-Refers-To").alias("refers"), field("WARC-Payload-Digest", r"sha1:([0-9a-f]+)").alias("digest"), field("WARC-Segment-Number").isNotNull().alias("segmented"),
        F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)).alias("number"), field("WARC-Segment-Total-Length").cast("long").alias("total"), content.alias("content"),
    )


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, bytes, digest of rows (rid, number, total, content), sorted; holds one digest, not the payload."""
    rid, digest, size, want, due, out = None, None, 0, 0, None, []

    def done() -> None:
        if due != size:
            raise ValueError(f"record {rid}: {size} bytes in segments, {due} expected")
        out.append((rid, size, digest.hexdigest()))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[], [], []]
        out.clear()
        return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["rid", "bytes", "seen"])

    for batch in batches:
        for r, number, total, content in zip(*(batch.column(k) for k in ("rid", "number", "total", "content")), strict=True):
            if r.as_py() != rid:
                if rid is not None:
                    done()
                rid, digest, size, want, due = r.as_py(), hashlib.sha1(), 0, 1, None
            if number.as_py() != want:
                raise ValueError(f"record {rid}: segment {want} is missing")
            want, due = want + 1, total.as_py()
            data = content.as_buffer()
            digest.update(data)
            size += data.size
        yield flush()
    if rid is not None:
        done()
        yield flush()


def payloads(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every payload, revisits by what they refer to.

    Raises if a stored digest isn't that of the bytes, or a segment is missing."""
    c = F.col
    whole = records.where(~c("segmented") & (c("type") == "response")).select("rid", F.octet_length("content").cast("long").alias("bytes"), F.sha1("content").alias("seen"))
    parts = records.where("segmented").select("rid", "number", "total", "content")
    parts = parts.repartition("rid").sortWithinPartitions("rid", "number").mapInArrow(_carry, "rid long, bytes long, seen string")
    heads = saved(records.where("number = 1").select("rid", "page_id", "type", "refers", "digest"))
    stored = saved(whole.unionByName(parts)).join(heads.where("type = 'response'").select("rid", c("page_id").alias("of_page"), c("digest").alias("of_digest")), "rid").withColumnRenamed("rid", "of")
    full = join_by_key(heads.withColumn("of", F.coalesce("refers", "rid")), stored, "of", "left")
    right = (c("seen") == c("digest")) & (c("of_digest") == c("digest"))
    digest = F.when(F.coalesce(right, F.lit(False)), c("seen")).otherwise(F.raise_error(F.concat(F.lit("digest differs in record "), c("rid").cast("string"))))
    return full.select("page_id", c("bytes").alias("payload_bytes"), digest.alias("payload_digest"), c("type").alias("record_type"), F.when(c("type") == "revisit", c("of_page")).alias("refers_to"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    write_archives(record_table(read(spark, sf_dir, "pages")), path)
    return payloads(read_archives(spark, path))


OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM g
"""
