"""WARC archives as tables, and a Merkle audit of their replicas.

An archive is a table of records: file, offset and the record's text. Its tree has the record hashes as leaves. Level 0
groups the records that start in the same `range_bytes` of a file; every level above groups `fan` neighbouring ranges, up
to one root a file. A node's hash is that of its children's positions and hashes in order, so that groups are bounded by
the range size and the fan-out, whatever the file's size.

The audit compares the roots of two replicas and descends level by level into the branches that differ, down to records.

Cases: a record that only one replica has is `missing` or `extra`, a whole file too; null url or html count as empty; null
ids are allowed; repeated pages are records of their own; an empty archive against a full one has every record missing;
two empty archives give no row; other columns of pages are not part of a record. A body may hold anything, version lines too.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.llm.common import table, written

RANGE_BYTES, FAN, FILE_BYTES = 64 * 1024, 16, 4 * 1024 * 1024
VERSION, END = "WARC/1.0\r\n", "\r\n\r\n"
#: Pages have no fetch time; records need one.
DATE = "2024-01-01T00:00:00Z"
MARK, HEAD_BYTES = b"WARC/1.", 64 * 1024
_RECORD = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("content_length", pa.int64()), ("html", pa.string()), ("complete", pa.bool_())])


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A resource record as text, its closing empty lines included. Line ends in an address go, as they would end its header."""
    html = F.coalesce(html, F.lit(""))
    uri = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "")
    return F.concat(F.lit(VERSION + "WARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
                    F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri, F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"),
                    F.lit("\r\n\r\n"), html, F.lit(END))


def records(pages: DataFrame) -> DataFrame:
    """(page_id, record, hash, length) of pages."""
    rows = pages.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    return rows.select("page_id", "record", F.sha2("record", 256).alias("hash"), F.octet_length("record").cast("long").alias("length"))


def layout(recs: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """recs (with hash, length and page_id) with file and offset: dealt to files by hash, laid out in the order of the hash.

    The number of files follows the bytes, so a file's rows are bounded by file_bytes. Equal records are numbered first,
    and the number is hashed too, so that copies spread over files. Columns that recs lacks, such as the text, are not moved.
    """
    total = recs.agg(F.sum("length")).first()[0] or 0
    files = total // file_bytes + 1
    each = recs.groupBy(*recs.columns).count().select(*recs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("_copy"))
    each = each.withColumn("_spread", F.when(F.col("_copy") == 1, F.col("hash")).otherwise(F.sha2(F.concat("hash", F.col("_copy").cast("string")), 256)))
    number = F.conv(F.substring("_spread", 1, 12), 16, 10).cast("long") % files
    place = W.partitionBy("file").orderBy("_spread", "page_id")
    return each.withColumn("file", number).select("file", (F.sum("length").over(place) - F.col("length")).alias("offset"), *recs.columns)


def archive(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(file, offset, page_id, record, hash, length) of pages, ready to be written."""
    return layout(records(pages), file_bytes)


def write_warc(arch: DataFrame, path: str, compression: str = "none") -> None:
    """WARC files under path, a folder a file number; records in the order of their offsets, at their offsets (compression: none or gzip)."""
    value = F.substring("record", F.lit(1), F.length("record") - 1)  # the writer ends each value with the line feed that ends the record
    (arch.repartition("file").sortWithinPartitions("file", "offset").select("file", value.alias("value"))
     .write.partitionBy("file").option("lineSep", "\n").option("compression", compression).text(path))


def walk(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes, bool]]:
    """(offset, headers, body, complete) of the records of a file, by their Content-Length; what a body holds is never looked at.

    A record without a length, or with less than it tells of, is not complete; the walk goes on at the next version line after it.
    """
    at = data.find(MARK)
    while at >= 0:
        head, gap, _ = data[at:at + HEAD_BYTES].partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, length = at + len(head) + len(gap), headers.get("content-length", "")
        size = int(length) if length.isascii() and length.isdigit() else None
        whole = size is not None and bool(gap) and data[start + size:start + size + 4] in (b"\r\n\r\n", b"") and start + size <= len(data)
        after = data.find(b"\r\n\r\n" + MARK, start)
        stop = start + size if whole else after if after >= 0 else len(data)
        yield at, headers, data[start:stop], whole
        at = data.find(MARK, stop)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, warc_type, target_uri, content_length, html, complete) of the records under path, plain or gzip.

    A file is read by one task; archives written here hold about `file_bytes` each. complete is false for a record that is
    shorter than its length, whose html is what there is of it. Offsets are those in the unpacked file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    file = F.col("file").cast("string") if "file" in files.columns else F.col("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b["file"].to_pylist(), b["content"], strict=True):
                data = data.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                for part in batched(walk(data), 500):
                    length = lambda h: int(x) if (x := h.get("content-length", "")).isascii() and x.isdigit() else None
                    rows = [(name, at, h.get("warc-type", ""), h.get("warc-target-uri", ""), length(h), body.decode("utf-8", "replace"), whole) for at, h, body, whole in part]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)

    return files.select(file.alias("file"), "content").mapInArrow(run, "file string, offset long, warc_type string, target_uri string, content_length long, html string, complete boolean")


def tree(arch: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> list[DataFrame]:
    """Levels of (file, place, hash) of an archive given as (file, offset, hash), records first (place is the offset), roots last (place is 0)."""
    levels = [written(arch.select("file", F.col("offset").alias("place"), "hash"))]
    width = range_bytes
    while True:
        below = levels[-1]
        joined = F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("place", "hash"))), lambda x: F.concat(x["place"].cast("string"), F.lit(":"), x["hash"])))
        levels.append(written(below.groupBy("file", F.expr(f"place div {width}").alias("place")).agg(F.sha2(joined, 256).alias("hash"))))
        if len(levels) > 1 and not (levels[-1].agg(F.max("place")).first()[0] or 0):
            return levels
        width = fan


def audit(ours: DataFrame, theirs: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """(file, offset, status, hash, replica_hash) of every record of which the replicas differ; status is changed, missing or extra (in theirs)."""
    a, b = tree(ours, range_bytes, fan), tree(theirs, range_bytes, fan)
    while len(a) != len(b):  # the replica with fewer levels gets roots over its roots
        low = a if len(a) < len(b) else b
        low.append(written(low[-1].select("file", F.lit(0).cast("long").alias("place"), F.sha2(F.concat(F.lit("0:"), F.col("hash")), 256).alias("hash"))))
    wrong = None
    for k in range(len(a) - 1, -1, -1):
        x, y = a[k], b[k]
        if wrong is not None:  # only the children of branches that differ
            up = F.expr(f"place div {range_bytes if k == 0 else fan}")
            parents = wrong.select("file", F.col("place").alias("_up"))
            x, y = (t.withColumn("_up", up).join(parents, ["file", "_up"], "left_semi") for t in (x, y))
        both = x.select("file", "place", "hash").join(y.select("file", "place", F.col("hash").alias("replica_hash")), ["file", "place"], "full")
        wrong = written(both.where(~F.col("hash").eqNullSafe(F.col("replica_hash"))))
    status = F.when(F.col("replica_hash").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("changed")
    return wrong.select("file", F.col("place").alias("offset"), status.alias("status"), "hash", "replica_hash")


def damaged(record_col: Column, hash_col: Column) -> Column:
    """Bit rot of a replica: records whose hash starts with 0 have another first byte, those with 1 are lost (null)."""
    start = F.substring(hash_col, 1, 1)
    return F.when(start == "0", F.concat(F.lit("#"), F.substring(record_col, F.lit(2), F.length(record_col)))).when(start != "1", record_col)


def query(spark, sf_dir) -> DataFrame:
    """op7: pages as an archive, audited against a replica with damage; one row per record that differs."""
    rotten = F.sha2(damaged(F.col("record"), F.col("hash")), 256)
    recs = records(table(spark, sf_dir, "pages")).select("page_id", "hash", "length", rotten.alias("_replica"))
    arch = written(layout(recs))
    replica = arch.where(F.col("_replica").isNotNull()).select("file", "offset", F.col("_replica").alias("hash"))
    found = audit(arch.select("file", "offset", "hash"), replica)
    return found.join(arch.select("file", "offset", "length", "page_id"), ["file", "offset"]).select(
        "file", "offset", "length", "page_id", "status", "hash", "replica_hash")


SQL = rf"""
WITH r AS (
    SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '')
        || '>' || chr(13) || chr(10) || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[\r\n]', '', 'g')
        || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
        || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
    FROM pages
), h AS (
    SELECT page_id, record, sha256(record) AS hash, CAST(strlen(record) AS BIGINT) AS length FROM r
), e AS (
    SELECT *, row_number() OVER (PARTITION BY page_id, hash) AS copy FROM h
), s AS (
    SELECT *, CASE WHEN copy = 1 THEN hash ELSE sha256(hash || copy) END AS spread FROM e
), f AS (
    SELECT *, CAST('0x' || substr(spread, 1, 12) AS BIGINT) % (SELECT CAST(floor(sum(length) / {FILE_BYTES}) AS BIGINT) + 1 FROM h) AS file FROM s
), a AS (
    SELECT file, CAST(sum(length) OVER (PARTITION BY file ORDER BY spread, page_id) - length AS BIGINT) AS "offset", length, page_id, hash, record FROM f
)
SELECT file, "offset", length, page_id, CASE WHEN hash LIKE '1%' THEN 'missing' ELSE 'changed' END AS status, hash,
    CASE WHEN hash LIKE '0%' THEN sha256('#' || substr(record, 2)) END AS replica_hash
FROM a WHERE hash LIKE '0%' OR hash LIKE '1%'
"""
