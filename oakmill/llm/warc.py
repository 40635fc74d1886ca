"""WARC records and a Merkle audit of their replicas.

Pages become WARC response records, laid out in files of ``PER_FILE`` consecutive page ids. A leaf hashes a
record's place (file, offset, length) and bytes; an inner node hashes its up to ``FANOUT`` children in order, so it
stands for an ordered range of offsets. A node is named by its level and the page id (counted from the least 64-bit
number, so that negative ids come first) divided by ``FANOUT ** level``: the same range in every replica, whichever
records one has lost. After 16 levels at most all ids are under one root.

An audit compares the roots and descends: a level's nodes are compared only below nodes that differ one level up.
Two intact replicas cost one comparison of roots; damage costs its branches.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oakmill.llm.common import table, written

FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
PER_FILE = 256
CRLF = "\r\n"
LEAST = -(1 << 63)


def _file_of(per_file: int):
    """Column: the number of the file that holds a page, rounded down; in whole numbers, as ids may be any 64-bit ones."""
    return F.expr(f"page_id div {per_file} - CASE WHEN page_id % {per_file} < 0 THEN 1 ELSE 0 END").cast("long")


def _above(node: str = "node"):
    return F.shiftrightunsigned(node, FANOUT_BITS)


def record_bytes(page_id, url, html):
    """Column: the bytes of a WARC/1.1 response record."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:page:"),
        page_id.cast("string"),
        F.lit(f">{CRLF}WARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(CRLF + CRLF),
    )
    return F.concat(head, body, F.lit(CRLF + CRLF)).cast("binary")


def records(pages: DataFrame) -> DataFrame:
    """``page_id, record`` (bytes) of each page. Null url and html count as empty; rows without an id are left out,
    as nothing names them; other columns are ignored."""
    page = F.col("page_id").cast("long")
    return pages.where(page.isNotNull()).select(page.alias("page_id"), record_bytes(page, F.col("url"), F.col("html")).alias("record"))


def leaves(recs: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """``page_id, file_id, offset, length, sha256, digest`` of each record; equal records of one id count once.

    Offsets follow from the lengths before in the file, by id (then by hash). Only digests and lengths are
    shuffled; a file has few ids, so its window is small.
    """
    hashed = recs.select(
        "page_id", _file_of(per_file).alias("file_id"), F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256")
    ).distinct()
    before = Window.partitionBy("file_id").orderBy("page_id", "sha256").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return placed.select(
        "page_id", "file_id", "offset", "length", "sha256", F.sha2(F.concat_ws(":", "file_id", "offset", "length", "sha256"), 256).alias("digest")
    )


def levels(leaf: DataFrame) -> list[DataFrame]:
    """Merkle levels from the leaves (``node, digest``) to one root, each written once; any 64-bit ids."""
    start = leaf.groupBy(F.col("page_id").bitwiseXOR(F.lit(LEAST)).alias("node")).agg(F.sha2(F.array_join(F.sort_array(F.collect_set("digest")), ""), 256).alias("digest"))
    out = [written(start, "merkle-0")]
    while out[-1].limit(2).count() > 1:
        child = F.struct("node", "digest")
        up = out[-1].groupBy(_above().alias("up")).agg(F.sort_array(F.collect_list(child)).alias("children"))
        digest = F.sha2(F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])), ";"), 256)
        out.append(written(up.select(F.col("up").alias("node"), digest.alias("digest")), f"merkle-{len(out)}"))
    return out


def _lifted(tree: list[DataFrame], height: int) -> list[DataFrame]:
    """The tree with roots over its root until it is as high as the other replica's."""
    while len(tree) < height:
        top = tree[-1]
        digest = F.sha2(F.concat_ws(":", F.col("node").cast("string"), "digest"), 256)
        tree = [*tree, top.select(_above().alias("node"), digest.alias("digest"))]
    return tree


def differing(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """Page ids whose leaves differ (``page_id``, ``in_left``, ``in_right``): from the roots down, level by level,
    only under nodes that differ."""
    height = max(len(left), len(right))
    left, right = _lifted(left, height), _lifted(right, height)
    under = None
    for level in range(height - 1, -1, -1):
        a, b = left[level].withColumnRenamed("digest", "a"), right[level].withColumnRenamed("digest", "b")
        if under is not None:
            a, b = (x.join(under, _above() == F.col("parent"), "left_semi") for x in (a, b))
        found = a.join(b, "node", "full").where(~F.col("a").eqNullSafe(F.col("b")))
        under = written(found.select(F.col("node").alias("parent"), F.col("a").isNotNull().alias("in_left"), F.col("b").isNotNull().alias("in_right")), "differing")
        if under.isEmpty():
            break
    return under.select(F.col("parent").bitwiseXOR(F.lit(LEAST)).alias("page_id"), "in_left", "in_right")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """One row for each record of either replica (two tables of ``page_id, record``): its place and hash in the
    primary (for one that only the replica has: there) and ``status``: ``intact``, ``altered`` (bytes), ``moved``
    (whole, but not at its offset), ``missing`` or ``extra`` in the replica.

    Equal records of an id count once. Two empty tables give an empty result.
    """
    left, right = written(leaves(primary), "leaves"), written(leaves(replica), "leaves")
    bad = differing(levels(left), levels(right))
    other = right.join(bad.select("page_id"), "page_id", "left_semi").groupBy("page_id").agg(F.collect_set("sha256").alias("_others"))
    status = (
        F.when(F.col("in_left").isNull(), "intact")
        .when(~F.col("in_right"), "missing")
        .when(F.array_contains("_others", F.col("sha256")), "moved")
        .otherwise("altered")
    )
    columns = ["page_id", "file_id", "offset", "length", "sha256"]
    rows = left.join(bad, "page_id", "left").join(other, "page_id", "left").select(*columns, status.alias("status"))
    extra = right.join(bad.where("NOT in_left").select("page_id"), "page_id", "left_semi").select(*columns, F.lit("extra").alias("status"))
    return rows.unionByName(extra)


def damaged(recs: DataFrame) -> DataFrame:
    """A replica with planted damage, the same for the same input: by id, a lost record, a changed or a cut end."""
    page, record = F.col("page_id"), F.col("record")
    kept = F.substring(record, F.lit(1), F.octet_length(record) - 5)
    changed = F.when(page % 101 == 7, F.concat(kept, F.lit("#" + CRLF + CRLF).cast("binary"))).when(page % 103 == 5, kept).otherwise(record)
    return recs.where(page % 107 != 3).select("page_id", changed.alias("record"))


def write_warc(recs: DataFrame, folder: str, per_file: int = PER_FILE) -> DataFrame:
    """Writes files ``<file_id>.warc`` to a folder that all executors share (an absolute path or the URI of a file system or
    object store); gives ``file_id, path, bytes``.

    One task writes a file at a time from records sorted by id, under a name of its own, and renames it when it is
    whole, so a repeated task does no harm.
    """

    def run(batches):
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        now, stream, last, done = None, None, None, []
        part, size = "", 0

        def close():
            if stream is not None:
                stream.close()
                files.move(part, f"{root}/{now}.warc")
                done.append((now, f"{root}/{now}.warc", size))

        for batch in batches:
            for file_id, page, record in zip(*(c.to_pylist() for c in batch.columns)):
                if last == (page, record):
                    continue  # equal records of an id count once
                last = page, record
                if file_id != now:
                    close()
                    now, part, size = file_id, f"{root}/.{file_id}.{uuid.uuid4().hex}", 0
                    stream = files.open_output_stream(part)
                stream.write(record)
                size += len(record)
        close()
        if done:
            yield pa.RecordBatch.from_pydict({k: [d[i] for d in done] for i, k in enumerate(("file_id", "path", "bytes"))})

    named = recs.select(_file_of(per_file).alias("file_id"), "page_id", "record")
    ordered = named.repartition("file_id").sortWithinPartitions("file_id", "page_id", F.sha2("record", 256))
    return ordered.mapInArrow(run, "file_id long, path string, bytes long")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """``path, offset, length, page_id, url, record, sha256`` of each record of the ``.warc`` files in a folder."""
    head = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.DOTALL)

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, rows = 0, []
                while found := head.match(data, at):
                    fields = dict(line.split(b": ", 1) for line in found.group(1).split(b"\r\n"))
                    end = found.end() + int(fields[b"Content-Length"]) + 4
                    record = data[at:end]
                    page = fields[b"WARC-Record-ID"].decode().removeprefix("<urn:page:").removesuffix(">")
                    rows.append((path, at, end - at, int(page), fields[b"WARC-Target-URI"].decode(), record, hashlib.sha256(record).hexdigest()))
                    at = end
                if at != len(data):
                    raise ValueError(f"{path}: no record at byte {at}")
                names = ("path", "offset", "length", "page_id", "url", "record", "sha256")
                if rows:
                    yield pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(names)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(folder).select("path", "content")
    return files.mapInArrow(run, "path string, offset long, length long, page_id long, url string, record binary, sha256 string")


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``audit`` of all pages against a second replica, which is made here with planted damage, as the tables hold one
    copy of each page. Null url and html count as empty, rows without an id are left out, repeated records count once."""
    recs = records(table(spark, sf_dir, "pages"))
    return audit(recs, damaged(recs))


SQL = rf"""
WITH r AS (
  SELECT page_id, page_id // {PER_FILE} AS file_id,
         'WARC/1.1' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Target-URI: '
         || coalesce(url, '') || e || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e
         || coalesce(html, '') || e || e AS record
  FROM pages, (SELECT chr(13) || chr(10) AS e) WHERE page_id IS NOT NULL
), p AS (
  SELECT DISTINCT page_id, file_id, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS sha256 FROM r
), d AS (
  SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY file_id ORDER BY page_id, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
         CASE WHEN page_id % 101 = 7 OR page_id % 103 <> 5 THEN length ELSE length - 5 END AS other_length
  FROM p
), s AS (
  SELECT *, coalesce(sum(CASE WHEN page_id % 107 = 3 THEN 0 ELSE other_length END)
                     OVER (PARTITION BY file_id ORDER BY page_id, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS other_offset
  FROM d
)
SELECT page_id, file_id, "offset", length, sha256,
       CASE WHEN page_id % 107 = 3 THEN 'missing' WHEN page_id % 101 = 7 OR page_id % 103 = 5 THEN 'altered'
            WHEN other_offset <> "offset" THEN 'moved' ELSE 'intact' END AS status
FROM s
"""
