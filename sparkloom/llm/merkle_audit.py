"""Fixity audit of two replicas of a WARC archive by Merkle trees.

Records are hashed; the hashes of a byte range of an archive file, in offset order, make a leaf; a fixed number of
neighbouring nodes make a parent, up to one root for each file, and over the files up to one root for the replica.
Equal roots end the audit. Otherwise only children of nodes that differ are compared, level by level, and only
records of ranges that differ are compared one by one, by their ids: a record that only moved is sound.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

RANGE_BYTES = 1 << 16
FANOUT = 16
CRLF = "\r\n"
NULL_FILES = 4096  # files that pages without an id are dealt to


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as the text of a WARC/1.0 resource record. Null html counts as empty; a null url has no header, one with line breaks is written in hex."""
    body = F.coalesce(html, F.lit(""))
    uri = F.when(url.rlike("[\r\n]"), F.concat(F.lit("WARC-Target-URI-Hex: "), F.hex(F.encode(url, "UTF-8")), F.lit(CRLF))).otherwise(F.concat(F.lit("WARC-Target-URI: "), url, F.lit(CRLF)))
    return F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(f">{CRLF}"), F.coalesce(uri, F.lit("")),
        F.lit(f"Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2), body, F.lit(CRLF * 2),
    )


def archive_records(pages: DataFrame, pages_per_file: int = 1024) -> DataFrame:
    """file, record_id, offset, length, digest for every page: records in order of page_id, so many ids to a file.

    Pages with a null page_id are dealt to files -1 to -NULL_FILES by their content. Equal rows are one record with a count, which is
    part of its digest.
    """
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    digest = F.sha2(record, 256)
    spread = -1 - F.pmod(F.xxhash64("url", "html"), F.lit(NULL_FILES))
    rows = pages.select(
        F.coalesce(F.floor(F.col("page_id") / pages_per_file), spread).cast("long").alias("file"), F.col("page_id").cast("long").alias("record_id"),
        F.octet_length(record).cast("long").alias("length"), digest.alias("digest"),
    )
    rows = rows.groupBy("file", "record_id", "length", "digest").agg(F.count("*").alias("copies"))
    before = Window.partitionBy("file").orderBy("record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("file", "record_id", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0)).alias("offset"), "length", F.sha2(F.concat_ws("*", "digest", "copies"), 256).alias("digest"))


_START = re.compile(rb"WARC/1\.[0-9]\r\n")
_LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)[ \t]*\r\n")
_ID = re.compile(rb"(?i)\r\nwarc-record-id:[ \t]*<urn:page:([0-9]+)>[ \t]*\r\n")


def parse_warc(data: bytes) -> list[tuple[int | None, int, int, str]]:
    """(record id, offset, length, digest of its bytes) of the records of a file. What can't be read as a record is one without an id, up to the next start."""
    out, at = [], 0
    while at < len(data):
        end, record_id = None, None
        head_end = data.find(b"\r\n\r\n", at)
        if _START.match(data, at) and head_end >= 0:
            head = data[at : head_end + 2]
            size, name = _LENGTH.search(head), _ID.search(head)
            if size:
                end = head_end + 4 + int(size[1]) + 4
                record_id = int(name[1]) if name else None
                if end > len(data) or data[end - 4 : end] != b"\r\n\r\n":
                    end = record_id = None
        if end is None:
            following = _START.search(data, at + 1)
            end = following.start() if following else len(data)
        part = data[at:end]
        out.append((record_id, at, len(part), hashlib.sha256(hashlib.sha256(part).hexdigest().encode() + b"*1").hexdigest()))
        at = end
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, record_id, offset, length, digest of the records of uncompressed WARC files named <number>.warc, as archive_records gives them. A task reads one file
    at a time (at most 2 GiB, as for any binary column)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(path).select(F.regexp_extract("path", r"(-?[0-9]+)[.]warc$", 1).cast("long").alias("file"), "content")

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                found = parse_warc(batch.column("content")[i].as_py())
                if found:
                    ids, offsets, lengths, digests = zip(*found)
                    columns = [pa.array([batch.column("file")[i].as_py()] * len(found), pa.int64()), pa.array(ids, pa.int64()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(digests)]
                    yield pa.RecordBatch.from_arrays(columns, ["file", "record_id", "offset", "length", "digest"])

    return files.mapInArrow(run, "file long, record_id long, offset long, length long, digest string")


def _parents(nodes: DataFrame, *keys: str) -> DataFrame:
    """One node for each key from at most FANOUT (in the lowest level: RANGE_BYTES) children, hashed in order."""
    kids = F.array_sort(F.collect_list(F.struct("at", "hash")))
    return nodes.groupBy(*keys).agg(kids.alias("kids")).select(*keys, F.sha2(F.concat_ws(",", F.transform("kids", lambda c: F.concat_ws(":", c["at"].cast("string"), c["hash"]))), 256).alias("hash"))


def tree(records: DataFrame, file_levels: int, top_levels: int) -> list[DataFrame]:
    """Levels from the leaves to the root, each with file, node, hash (above the files: file null)."""
    leaf = records.select("file", F.floor(F.col("offset") / RANGE_BYTES).cast("long").alias("node"), F.struct("offset", "record_id").alias("at"), F.col("digest").alias("hash"))
    levels = [table(_parents(leaf, "file", "node"))]
    for _ in range(file_levels):
        up = levels[-1].select("file", F.floor(F.col("node") / FANOUT).cast("long").alias("up"), F.col("node").alias("at"), "hash")
        levels.append(_parents(up, "file", "up").withColumnRenamed("up", "node"))
    # roots of files become the lowest nodes of the upper tree
    files = levels[-1].select(F.lit(None).cast("long").alias("file"), F.col("file").alias("node"), "hash")
    for i in range(top_levels):
        up = (files if not i else levels[-1]).select(F.floor(F.col("node") / FANOUT).cast("long").alias("up"), F.col("node").alias("at"), "hash")
        levels.append(_parents(up, "up").select(F.lit(None).cast("long").alias("file"), F.col("up").alias("node"), "hash"))
    return levels


def _levels(n: int) -> int:
    k = 0
    while FANOUT**k < n:
        k += 1
    return k


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records that differ: file, record_id, offset, status (`corrupt`, `missing` or `extra` in the replica).

    Both sides hold file, record_id, offset, digest. Of records that differ, those that share (file, record_id) are corrupt, the offset being
    the primary's; a record at another offset with the same digest is sound. Equal replicas, or empty ones: no rows. Nodes that differ are found by joins that start at the root, so what is compared shrinks with the damage.
    """
    both = primary.select("file", "offset").unionByName(replica.select("file", "offset"))
    most, low, high = both.agg(F.max("offset"), F.min("file"), F.max("file")).first()
    if most is None:
        return primary.select("file", "record_id", "offset", F.lit("").alias("status")).limit(0)
    in_file = _levels(most // RANGE_BYTES + 1)
    over = 1 + max(_levels(high + 1), _levels(-low))  # node numbers of the upper tree may be negative: -1 keeps its own branch
    ours, theirs = tree(primary, in_file, over), tree(replica, in_file, over)

    def differing(level: int, within: DataFrame | None) -> DataFrame:
        a, b = ours[level], theirs[level]
        if within is not None:
            upper = level >= in_file + 1  # a node of the upper tree
            top_of_file = level == in_file
            up = F.floor(F.col("file" if top_of_file else "node") / FANOUT).cast("long")
            cond = ["up"] if upper or top_of_file else ["file", "up"]
            keys = within.select(F.col("node").alias("up"), *(["file"] if len(cond) == 2 else []))
            a, b = (x.withColumn("up", up).join(keys, cond, "left_semi").select("file", "node", "hash") for x in (a, b))
        a, b = a.alias("a"), b.alias("b")
        same = F.col("a.file").eqNullSafe(F.col("b.file")) & (F.col("a.node") == F.col("b.node"))
        return a.join(b, same, "full").where(~F.col("a.hash").eqNullSafe(F.col("b.hash"))).select(F.coalesce("a.file", "b.file").alias("file"), F.coalesce("a.node", "b.node").alias("node"))

    bad = None
    for level in range(in_file + over, -1, -1):
        bad = table(differing(level, bad))
        if bad.isEmpty():
            break
    p, r = (
        x.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES).cast("long")).join(bad, ["file", "node"], "left_semi").select("file", "offset", "record_id", "digest")
        for x in (primary, replica)
    )
    # only in one replica, wherever it stands
    key = F.coalesce(F.col("record_id"), F.lit(-1)).alias("key")
    p, r = (table(x.select(key, "*")) for x in (p, r))
    lost, new = p.join(r, ["file", "key", "digest"], "left_anti"), r.join(p, ["file", "key", "digest"], "left_anti")
    known = lambda x, name: x.where("record_id IS NOT NULL").select("file", "key").distinct().withColumn(name, F.lit(True))
    lost_as = lost.join(known(new, "there"), ["file", "key"], "left").select("file", "record_id", "offset", F.when(F.col("there"), "corrupt").otherwise("missing").alias("status"))
    new_as = new.join(known(lost, "there"), ["file", "key"], "left").where("there IS NULL").select("file", "record_id", "offset", F.lit("extra").alias("status"))
    return lost_as.unionByName(new_as)
