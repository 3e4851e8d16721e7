"""Benchmark decontamination: size-partitioned MinHash containment search, native only.

A short item lies inside a document if at least ``threshold`` of the item's distinct
word shingles are shingles of the document, however long that is. Jaccard sketches
of whole documents say little about so short an item, so the sketch belongs to the
item and its length to the item's size: of m shingles the floor((1 - threshold) * m)
+ 1 with the smallest hashes. A document that holds the item must hold one of these,
so no item is missed. Items are partitioned by size in powers of two; each
partition has the largest hash of its sketches, and a document's shingles above the
largest of these are dropped before any row is made of them.

Documents with a sketch hit are verified: their shingles are counted exactly against
the shingles of the items they hit.

An item of fewer than five words is the one run of all its words, searched among the
runs of that length. Items and documents that are null or have no words hit nothing.
An item is its id and text: texts that share an id, or have none, are found each by
its own size, and so are equal texts with different ids. Repeated items and repeated
documents (same id, same text) are one finding. Extra columns are ignored.

Very long documents are read whole. Tables without documents or items give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.staging import stage
from .shingles import WORDS, shingle_hashes, word_hashes

THRESHOLD = 0.75


def item_shingles(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per distinct item with words: item_key, item_id, length of its runs, set size m, partition, shingles, sketch."""
    # the key is never null and tells a null id from any other
    key = F.xxhash64(F.col("item_id").isNull(), "item_id", F.col("text").cast("string"))
    keyed = items.select(key.alias("item_key"), "item_id", "text").dropDuplicates(["item_key"])
    words = keyed.select("item_key", "item_id", word_hashes("text").alias("w")).where(F.size("w") > 0)
    short = [F.when(F.size("w") == k, shingle_hashes("w", k)) for k in range(1, WORDS)]
    runs = words.select(
        "item_key",
        "item_id",
        F.least(F.size("w"), F.lit(WORDS)).alias("run"),
        F.array_sort(F.array_distinct(F.coalesce(*short, shingle_hashes("w")))).alias("shingles"),
    )
    m = F.size("shingles")
    # percents avoid rounding: floor(m - threshold * m) + 1
    kept = F.floor((F.lit(100) - round(100 * threshold)) * m / 100).cast("int") + 1
    return runs.select("item_key", "item_id", "run", m.alias("m"), F.floor(F.log2(m)).cast("int").alias("part"), "shingles", F.slice("shingles", F.lit(1), kept).alias("sketch"))


def contained(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_key, doc_id, item_id, shared, item_size of every item that lies inside a document."""
    known = stage(item_shingles(items, threshold), "items")
    # one row per size partition and run length: at most 2 * 31 * 5 numbers
    parts = known.groupBy("part", "run").agg(F.max(F.array_max("sketch")).alias("top")).collect()
    runs = sorted({r["run"] for r in parts}) or [WORDS]
    top = {k: max([r["top"] for r in parts if r["run"] == k], default=-1) for k in runs}
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).select(
        "doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), word_hashes("text").alias("w")
    )

    def low(run: int) -> F.Column:
        return F.filter(shingle_hashes("w", run), lambda h: h <= top[run])

    # explode_outer: a plain explode would filter on the array first and so compute it twice
    found = rows.select("doc_key", F.concat(*[low(k) for k in runs]).alias("low")).select("doc_key", F.explode_outer("low").alias("h"))
    # written first, so that Spark knows its size when it picks the join
    sketches = stage(known.select("item_key", F.explode("sketch").alias("h")), "sketches")
    hits = stage(found.join(sketches, "h").select("doc_key", "item_key").distinct(), "hits")
    full = known.join(hits.select("item_key").distinct(), "item_key", "left_semi")
    wanted = stage(full.select("item_key", "item_id", "m", F.explode("shingles").alias("h")), "wanted")
    suspects = rows.join(hits.select("doc_key").distinct(), "doc_key", "left_semi")
    every = suspects.select("doc_id", "doc_key", F.explode_outer(F.concat(*[shingle_hashes("w", k) for k in runs])).alias("h"))
    shared = every.join(wanted, "h").groupBy("doc_key", "doc_id", "item_key", "item_id", F.col("m").alias("item_size")).agg(F.countDistinct("h").alias("shared"))
    enough = shared.where(F.col("shared") * 100 >= round(100 * threshold) * F.col("item_size"))
    return enough.select("doc_key", "doc_id", "item_id", "shared", "item_size")


def clean(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` without those that hold an item; all copies of a row share its fate."""
    columns = documents.columns
    hit = contained(documents, items, threshold).select("doc_key").distinct()
    keyed = documents.withColumn("__doc_key", F.xxhash64("doc_id", F.col("text").cast("string")))
    return keyed.join(hit, keyed["__doc_key"] == hit["doc_key"], "left_anti").select(*columns)
