"""SpotSigs document fingerprints, in native expressions only.

Each common word of a text is an anchor; with the ``CHAIN`` content words that
follow it (common words skipped) it forms a spot signature. A fingerprint is the
set of a text's signatures, each a 40-bit hash, in ascending order. Two
fingerprints are as alike as the Jaccard similarity of their sets. ``near_pairs``
finds alike fingerprints of a whole table: equal ones are one class; sets are
partitioned by length so that only neighbouring partitions can be alike; within
them only the few smallest signatures of a set are compared first, and the rest
only if lengths and the parities of the signatures' bits still allow the threshold.
No pair at or above the threshold is missed. ``near_documents`` says for each
document which class it is in, how many documents that has, and how many are in alike ones.

A text without signatures (empty, null, or without anchors before content words)
has one: the hash of the whole text. So equal texts have equal fingerprints, and
two such texts are alike only if equal. Repeated rows are kept as rows.

Very long texts are read whole. Repeated rows have a fingerprint each, equal ones for equal texts.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import stage

# Common words of English, French, German and Spanish.
ANCHORS = """
a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their
there they this to was were which will with you
au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous ou par pas pour que qui sa se
ses son sur un une vous
als auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im ist mit nicht nach oder
sich sie sind so und von war wie wird zu zum zur
al como con del el ella era esta este ha la las lo los más no o para pero por se sin sobre su sus un una y ya
""".split()
CHAIN = 2
BITS = 40
THRESHOLD = 0.75
PARITIES = 2  # words of 64 parity bits per set


def signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the sorted, distinct signatures of column ``text`` as array<bigint>."""
    anchors = ", ".join(f"'{w}'" for w in sorted(set(ANCHORS)))
    chain = ", ".join(f"get(__content, __i - __r + {k})" for k in range(CHAIN))
    columns = df.columns
    # the r-th anchor stands behind as many content words as its place less r
    words = df.select("*", F.expr(f"split(regexp_replace(lower({text}), '^[^\\\\p{{L}}\\\\p{{N}}]+', ''), '[^\\\\p{{L}}\\\\p{{N}}]+')").alias("__words"))
    parts = words.select(
        "*",
        F.expr(f"filter(__words, w -> w NOT IN ({anchors}) AND w <> '')").alias("__content"),
        F.expr(f"filter(sequence(0, size(__words) - 1), i -> __words[i] IN ({anchors}))").alias("__places"),
    )
    hashed = parts.select(
        *columns,
        F.expr(
            f"""array_sort(array_distinct(transform(filter(__places, (i, r) -> i - r < size(__content)),
                (__i, __r) -> shiftrightunsigned(xxhash64(__words[__i], {chain}), {64 - BITS}))))"""
        ).alias("__found"),
    )
    whole = F.array(F.shiftrightunsigned(F.xxhash64(F.lit(""), F.col(text)), 64 - BITS))
    return hashed.select(*columns, F.when(F.size("__found") > 0, F.col("__found")).otherwise(whole).alias(out))


def fingerprint(signatures: str) -> Column:
    """The signatures as text."""
    return F.array_join(F.col(signatures).cast("array<string>"), " ")


def likeness(left: str, right: str) -> Column:
    """Jaccard similarity of two signature columns."""
    common = F.size(F.array_intersect(left, right))
    return common / (F.size(left) + F.size(right) - common).cast("double")


def members(documents: DataFrame) -> DataFrame:
    """Each row's doc_id, signatures and class; equal fingerprints are one class."""
    rows = signatures(documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")), "t", "sigs")
    return rows.select("doc_id", "sigs", F.unhex(F.md5(fingerprint("sigs").cast("binary"))).alias("class"))


def near_pairs(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """class_a, class_b, likeness of every two of the distinct ``classes`` (class, sigs) alike enough.

    Each pair comes once. A set of m signatures can reach the threshold only with sets
    that share one of its floor((1 - threshold) * m) + 1 smallest. A partition has the
    sets of lengths between two powers of 1 / threshold, so a partner is in the same or
    a neighbouring one. Signatures that differ flip parity bits: two sets whose
    parities differ in more bits than sets so alike may differ in signatures are no pair.
    """
    percent = round(100 * threshold)  # whole percents avoid rounding
    m = F.size("sigs")
    parities = [
        F.expr(f"aggregate(filter(sigs, s -> (shiftright(s, 6) % {PARITIES}) = {k}), 0L, (a, s) -> a ^ shiftleft(1L, int(s & 63)))").alias(f"p{k}")
        for k in range(PARITIES)
    ]
    smallest = F.slice("sigs", F.lit(1), F.floor((100 - percent) * m / 100).cast("int") + 1)
    part = F.floor(F.log(m.cast("double")) / -math.log(threshold)).cast("int") if percent < 100 else m
    keys = classes.select("class", m.alias("m"), part.alias("part"), *parities, F.explode(smallest).alias("h"))
    shared = keys.groupBy("h").count().where("count > 1").select("h")
    keys = stage(keys.join(shared, "h", "left_semi"), "spot-keys")
    a = keys.withColumn("part", F.explode(F.array("part", F.col("part") + 1))).alias("a")
    b = keys.alias("b")
    ordered = F.struct("a.m", "a.class") < F.struct("b.m", "b.class")
    total = F.col("a.m") + F.col("b.m")
    flipped = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a.p{k}").bitwiseXOR(F.col(f"b.p{k}"))) for k in range(PARITIES)])
    possible = (F.col("a.m") * 100 >= F.col("b.m") * percent) & (flipped * (100 + percent) <= total * (100 - percent))
    same = (F.col("a.h") == F.col("b.h")) & (F.col("a.part") == F.col("b.part"))
    met = a.join(b, same & ordered & possible).select(F.col("a.class").alias("class_a"), F.col("b.class").alias("class_b"))
    met = stage(met.distinct(), "spot-met")
    left = classes.select(F.col("class").alias("class_a"), F.col("sigs").alias("a"))
    right = classes.select(F.col("class").alias("class_b"), F.col("sigs").alias("b"))
    both = met.join(left, "class_a").join(right, "class_b")
    common = both.select("class_a", "class_b", F.size(F.array_intersect("a", "b")).alias("n"), (F.size("a") + F.size("b")).alias("total"))
    alike = common.where(F.col("n") * 100 >= (F.col("total") - F.col("n")) * percent)
    return alike.select("class_a", "class_b", (F.col("n") / (F.col("total") - F.col("n"))).alias("likeness"))


def near_documents(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, class_id, rows of its class, rows of other classes that are alike, and the largest likeness to these."""
    rows = stage(members(documents), "spot-members")
    classes = stage(rows.groupBy("class", "sigs").agg(F.count(F.lit(1)).alias("n_equal")), "spot-classes")
    pairs = stage(near_pairs(classes, threshold), "spot-pairs")
    ways = pairs.select(F.col("class_a").alias("class"), F.col("class_b").alias("other"), "likeness").unionByName(
        pairs.select(F.col("class_b").alias("class"), F.col("class_a").alias("other"), "likeness")
    )
    counts = classes.select("class", "n_equal")
    near = ways.join(counts.select(F.col("class").alias("other"), "n_equal"), "other").groupBy("class").agg(F.sum("n_equal").alias("n_near"), F.max("likeness").alias("nearest"))
    known = counts.join(near, "class", "left").where("n_equal > 1 OR n_near > 0")
    return rows.select("doc_id", "class").join(known, "class", "left").select(
        "doc_id",
        F.lower(F.hex("class")).alias("class_id"),
        F.coalesce("n_equal", F.lit(1)).alias("n_equal"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        "nearest",
    )


def next_document(documents: DataFrame) -> DataFrame:
    """Each row's doc_id, text ``t`` and signatures ``sigs``, with those of the next row in descending doc_id.

    Rows are dealt by ranges of doc_id, so that one shuffle of the texts brings
    neighbours together; each range also gets a copy of the first row of the range
    below it, and the lowest that of the highest. Null ids come last, equal ids in the order
    of their texts' hashes. Only ids, hashes and one row per range pass the driver.
    """
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    ranged = in_ranges(rows, "doc_id")
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.xxhash64("t").alias("hash"))
    heads = [tuple(r) for r in ranged.groupBy("range").agg(F.max(key).alias("head")).orderBy("range").select("range", "head.doc_id", "head.hash").collect()]
    copies = ranged.limit(0).select("range", "doc_id", "t")
    if heads:
        above = {heads[i + 1][0]: heads[i][0] for i in range(len(heads) - 1)} | {heads[0][0]: heads[-1][0]}
        ids = [h[1] for h in heads if h[1] is not None]
        wanted = F.col("doc_id").isin(ids) | F.col("doc_id").isNull() if any(h[1] is None for h in heads) else F.col("doc_id").isin(ids)
        exact = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("t").cast("string"))
        names = [":".join(str(x) for x in h[1:] if x is not None) for h in heads]
        moved = F.create_map(*[x for k, v in above.items() for x in (F.lit(k), F.lit(v))])
        copies = (
            ranged.where(wanted)
            .where(exact.isin(names))
            .groupBy("range", "doc_id", F.xxhash64("t").alias("hash"))
            .agg(F.first("t").alias("t"))
            .select(moved[F.col("range")].alias("range"), "doc_id", "t")
        )
    both = ranged.select("range", "doc_id", "t", F.lit(0).alias("copy")).unionByName(copies.select("range", "doc_id", "t", F.lit(1).alias("copy")))
    dealt = signatures(both.repartition("range"), "t", "sigs")
    order = Window.partitionBy("range").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.xxhash64("t").desc())
    following = F.lead(F.struct("t", "sigs")).over(order)
    return dealt.select("doc_id", "copy", "t", "sigs", following.alias("n")).where("copy = 0").drop("copy")


def in_ranges(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with the number of a range of descending ``key``; null keys go to the last."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = 4 * partitions
    value = F.col(key).cast("double")
    cuts = rows.agg(F.percentile_approx(value, [i / count for i in range(1, count)], 100 * count)).first()[0] or []
    cuts = sorted({c for c in cuts if math.isfinite(c)})
    if len(cuts) < 2:
        return rows.select("*", F.when(F.col(key).isNull(), 1).otherwise(0).alias("range"))
    split = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__key", outputCol="__range", handleInvalid="keep")
    numbered = split.transform(rows.withColumn("__key", F.coalesce(value, F.lit(-math.inf))))
    last = len(cuts) + 1
    return numbered.select(*rows.columns, F.when(F.col(key).isNull(), last).otherwise(len(cuts) - F.col("__range").cast("int")).alias("range"))


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to each other and to the next row's."""
    rows = next_document(documents).withColumn("n_chars", F.length("t").cast("long"))
    edited = F.expr("concat(substring(t, 1, int(n_chars - n_chars div 3)), substring(n.t, 1, int(n_chars div 3)))")
    rows = signatures(rows.withColumn("edited", edited), "edited", "edited_sigs")
    rows = rows.withColumn("next_sigs", F.col("n.sigs"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("sigs").alias("fingerprint"),
        fingerprint("edited_sigs").alias("edited_fingerprint"),
        likeness("sigs", "edited_sigs").alias("near_edited"),
        likeness("sigs", "next_sigs").alias("near_next"),
    )
