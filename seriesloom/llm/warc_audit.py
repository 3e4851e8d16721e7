"""WARC files and their fixity audit by Merkle trees.

``write`` turns pages into WARC files, ``read`` parses the files of a folder into
records with archive, offset, length and the SHA-256 of the record's bytes, and
``audit`` compares two such tables.

Leaves of an archive's tree are ordered offset ranges of ``LEAF_BYTES``: a leaf's hash covers
offset, length and hash of the records that begin in it, in order. A node's hash
covers the numbers and hashes of its at most ``FANOUT`` children. Replicas exchange
roots first; then, level by level, only children of nodes that differ. Records are
compared in the leaves that differ alone, by their ids: ``corrupt`` (other bytes),
``missing``, ``extra``, ``moved`` (same bytes elsewhere in the archive) and
``damaged`` (a stretch without a readable header).

An archive absent from one side differs as a whole. Pages without an id go to archives of
their own by a hash of their bytes, so that these stay small; a null html is an empty block, a
null url an empty target. Records with the same id in an archive are paired by equal bytes
first, then in order of their offsets, and each that differs has a row of its own; so
have repeated rows. A very long page is one record, and a file's records are read from
its whole bytes. Extra columns are ignored. Empty tables differ in nothing.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.staging import stage

PAGES_PER_ARCHIVE = 1000
NO_ID_ARCHIVES = 1 << 16
LEAF_BYTES = 1 << 16
FANOUT = 8
DATE = "2024-01-01T00:00:00Z"
BREAK = "\r\n\r\n"
RECORD_SCHEMA = "archive string, offset long, length long, record_id string, target string, sha256 string"


def record(page_id: str = "page_id", url: str = "url", html: str = "html") -> Column:
    """A page as WARC record, without the two line breaks that end it."""
    block = F.coalesce(F.col(html).cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col(page_id).cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(F.regexp_replace(F.col(url).cast("string"), r"[\r\n]", ""), F.lit("")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nContent-Type: text/html\r\nWARC-Block-Digest: sha256:"),
        F.sha2(block, 256),
        F.lit("\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(BREAK),
        block,
    )


def archive(page_id: str = "page_id", pages: int = PAGES_PER_ARCHIVE, html: str = "html") -> Column:
    """The archive of a page: consecutive ids share one; pages without an id are dealt by a hash of their bytes."""
    dealt = F.concat(F.lit("none-"), F.lpad(F.hex(F.pmod(F.xxhash64(html), F.lit(NO_ID_ARCHIVES))), 4, "0"))
    return F.coalesce(F.floor(F.col(page_id) / pages).cast("string"), dealt)


def write(pages: DataFrame, path: str, name: Column | None = None, page_id: str = "page_id") -> None:
    """Write pages as gzipped WARC files, one per archive, in order of their ids.

    Each record ends with two line breaks, which are the lines' separator here.
    """
    rows = pages.select((name if name is not None else archive(page_id)).alias("archive"), F.col(page_id).alias("__id"), record(page_id).alias("value"))
    (
        rows.repartition("archive")
        .sortWithinPartitions("archive", "__id", "value")
        .drop("__id")
        .write.partitionBy("archive")
        .option("lineSep", BREAK)
        .option("compression", "gzip")
        .text(path)
    )


HEADER = re.compile(rb"WARC/1\.[01]\r\n(?:[^\r\n]+\r\n)+\r\n")
NEXT = re.compile(rb"\r\n\r\n(?=WARC/1\.[01]\r\n)")


def records(data: bytes) -> Iterator[tuple[int, int, str, str, str]]:
    """offset, length, record id, target and SHA-256 of each record of a file's bytes."""
    at = 0
    while at < len(data):
        head = HEADER.match(data, at)
        fields = dict(re.findall(rb"^([^:\r\n]+): ?([^\r\n]*)", head.group(), re.M)) if head else {}
        size = fields.get(b"Content-Length", b"")
        end = head.end() + int(size) if head and size.isdigit() else -1
        if end < 0 or data[end : end + 4] != b"\r\n\r\n":
            found = NEXT.search(data, at + 1)  # what the header says is wrong: go on at the next header
            end = found.start() if found else len(data[at:].rstrip(b"\r\n")) + at
        stop = max(min(end + 4, len(data)), at + 1)
        name = fields.get(b"WARC-Record-ID", b"").decode("utf-8", "replace").strip("<>")
        yield at, stop - at, name, fields.get(b"WARC-Target-URI", b"").decode("utf-8", "replace"), hashlib.sha256(data[at:stop]).hexdigest()
        at = stop


def _inflated(data: bytes) -> bytes:
    """A file's bytes; all members of a gzip file, as far as they can be read."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files below a folder of archives, one task at a time holding one file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("archive", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "offset", "length", "record_id", "target", "sha256"]
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(records(_inflated(batch.column(1)[i].as_py() or b"")))
                columns = list(zip(*found)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                group = pa.array([str(batch.column(0)[i].as_py())] * len(found), pa.string())
                yield pa.RecordBatch.from_arrays([group, *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return files.mapInArrow(run, RECORD_SCHEMA)


def levels(records: DataFrame, height: int, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """The tree's levels from the leaves to the roots, each written once: archive, node, hash."""
    entry = F.concat_ws(":", "offset", "length", "sha256")
    ordered = F.sort_array(F.collect_list(F.struct("offset", entry.alias("e"))))
    leaf = records.groupBy("archive", F.floor(F.col("offset") / leaf_bytes).alias("node"))
    out = [stage(leaf.agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["e"]), ","), 256).alias("hash")), "leaves")]
    for _ in range(height):
        children = F.sort_array(F.collect_list(F.struct("node", F.concat_ws(":", "node", "hash").alias("e"))))
        parent = out[-1].groupBy("archive", F.floor(F.col("node") / fanout).alias("parent"))
        hashes = parent.agg(F.sha2(F.array_join(F.transform(children, lambda x: x["e"]), ","), 256).alias("hash"))
        out.append(stage(hashes.withColumnRenamed("parent", "node"), "nodes"))
    return out


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nodes of a level that differ or stand on one side only: archive, node."""
    a, b = left.withColumnRenamed("hash", "a"), right.withColumnRenamed("hash", "b")
    return a.join(b, ["archive", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("archive", "node")


def audit(left: DataFrame, right: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> DataFrame:
    """archive, record_id, status, offset and length (on the left where it has the record).

    ``left`` and ``right`` should be written tables: they are read for the leaves and again for the records that differ.
    """
    longest = max(((side.agg(F.max("offset")).first()[0] or 0) for side in (left, right)))
    height = 0
    while longest // leaf_bytes // fanout**height:
        height += 1
    trees = [levels(side, height, leaf_bytes, fanout) for side in (left, right)]
    suspects = differing(trees[0][height], trees[1][height])
    for level in range(height - 1, -1, -1):
        parents = suspects.withColumnRenamed("node", "parent")
        below = [
            tree[level].withColumn("parent", F.floor(F.col("node") / fanout)).join(parents, ["archive", "parent"], "left_semi").select("archive", "node", "hash")
            for tree in trees
        ]
        suspects = stage(differing(*below), "suspects")
    sides = []
    for side in (left, right):
        inside = side.withColumn("node", F.floor(F.col("offset") / leaf_bytes)).join(suspects, ["archive", "node"], "left_semi")
        sides.append(inside.withColumn("record_id", F.when(F.col("record_id") == "", F.concat(F.lit("offset:"), "offset")).otherwise(F.col("record_id"))))
    return _by_record(*sides)


def _by_record(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records of one id are paired by equal bytes first, then in order; each has a row of its own."""
    numbered = lambda side, keys, order: side.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = ["archive", "record_id", "sha256"]
    sides = [
        numbered(side, same, ["offset"]).select(*same, "nth", F.struct("offset", "length").alias(name)) for side, name in ((left, "a"), (right, "b"))
    ]
    # both ways of pairing begin with what has no partner of equal bytes
    first = stage(sides[0].join(sides[1], [*same, "nth"], "full"), "paired")
    damaged = F.col("record_id").startswith("offset:")
    moved = first.where(F.col("a.offset") != F.col("b.offset")).withColumn("status", F.when(damaged, "damaged").otherwise("moved"))
    rest = [
        numbered(first.where(f"{other} IS NULL"), ["archive", "record_id"], [f"{name}.offset"]).select("archive", "record_id", "nth", name)
        for name, other in (("a", "b"), ("b", "a"))
    ]
    status = F.when(damaged, "damaged").when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").otherwise("corrupt")
    changed = rest[0].join(rest[1], ["archive", "record_id", "nth"], "full").withColumn("status", status)
    at = F.coalesce("a", "b")
    shown = ["archive", "record_id", "status", at["offset"].alias("offset"), at["length"].alias("length")]
    return moved.select(*shown).unionByName(changed.select(*shown))
