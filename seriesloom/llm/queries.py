"""One query per operator over its whole table, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.staging import stage, staging_path
from . import (
    conversation_repair,
    decontaminate,
    hard_negatives,
    html_text,
    id_files,
    license_scan,
    pieces,
    quality,
    secret_scan,
    shingle_join,
    spotsigs,
    token_count,
    warc_audit,
)

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "piece_bpe_32k.model"
BYTE_TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 4096


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    encoded = pieces.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    checked = pieces.decode(encoded, path)
    return checked.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        "ids",
        (F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), "▁", " ")).alias("round_trip"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP3_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.r)
SELECT reach.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.doc_id GROUP BY reach.doc_id
"""


def op4_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a second replica of the pages' archives, of which some records were altered or lost.

    The replica is derived from the pages: FLIPPED pages have their first character
    replaced, LOST ones are left out.
    """
    pages = read(spark, sf_dir, "pages")
    flipped = F.concat(F.lit("#"), F.expr("substring(html, 2)"))
    replica = pages.where(~F.coalesce(F.expr(LOST), F.lit(False))).withColumn("html", F.when(F.expr(FLIPPED), flipped).otherwise(F.col("html")))
    sides = []
    for name, side in (("first", pages), ("second", replica)):
        path = staging_path(spark, f"warc-{name}")
        warc_audit.write(side, path)
        sides.append(stage(warc_audit.read(spark, path), f"records-{name}"))
    return warc_audit.audit(*sides)


FLIPPED = "page_id % 97 = 5 AND substring(html, 1, 1) = '<'"
LOST = "page_id % 499 = 3"
# bytes of a record that are the same in all
OP4_FIXED = len(
    "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:>\r\nWARC-Target-URI: \r\n"
    f"WARC-Date: {warc_audit.DATE}\r\nContent-Type: text/html\r\nWARC-Block-Digest: sha256:\r\nContent-Length: \r\n\r\n\r\n\r\n"
) + 64
OP4_SQL = f"""
WITH sized AS (
  SELECT page_id, html, ({FLIPPED}) AS flipped, ({LOST}) AS lost,
         CAST(CAST(floor(page_id / {warc_audit.PAGES_PER_ARCHIVE}) AS BIGINT) AS VARCHAR) AS archive,
         {OP4_FIXED} + strlen(CAST(page_id AS VARCHAR)) + strlen(url) + strlen(CAST(strlen(html) AS VARCHAR)) + strlen(html) AS length
  FROM pages),
placed AS (
  SELECT *, sum(length) OVER w - length AS offset_, count(*) FILTER (WHERE lost) OVER w AS lost_before
  FROM sized WINDOW w AS (PARTITION BY archive ORDER BY page_id ROWS UNBOUNDED PRECEDING))
SELECT archive, 'urn:page:' || page_id AS record_id,
       CASE WHEN lost THEN 'missing' WHEN flipped THEN 'corrupt' ELSE 'moved' END AS status,
       CAST(offset_ AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length
FROM placed WHERE lost OR flipped OR lost_before > 0
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("shared").cast("long").alias("shared"), F.col("item_size").cast("long").alias("item_size"))


OP6_SQL = """
WITH words AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
shingles AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words WHERE len(w) >= 5),
sizes AS (SELECT id, count(*) AS n FROM shingles WHERE side = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared, any_value(n) AS item_size
FROM shingles d JOIN shingles b ON d.s = b.s AND d.side = 0 AND b.side = 1 JOIN sizes ON sizes.id = b.id
GROUP BY d.id, b.id HAVING count(*) * 100 >= 75 * any_value(n)
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_count.token_counts(documents, tokenizer_path())
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    return token_count.with_limit(counted.select("doc_id", size, "n_tokens"), TOKEN_LIMIT)


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(read(spark, sf_dir, "documents"))


def op8_spotsigs_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alike documents of the whole table, beside the fingerprints of ``op8_spotsigs``."""
    return spotsigs.near_documents(read(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(read(spark, sf_dir, "documents"), repository=["source", "lang"]))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = quality.score(documents.select("doc_id", "text"), quality.train(documents, labels))
    return scored.select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "token-files")
    id_files.write(read(spark, sf_dir, "documents"), path, tokenizer_path(BYTE_TOKENIZER), end_id=0)
    return id_files.read(spark, path, ids=False)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations damaged by a checksum, their faults, and the cheapest repair."""
    conversations = read(spark, sf_dir, "conversations")
    rows = conversation_repair.damage(conversations)
    reported = stage(conversation_repair.report(rows), "report")
    hashes = conversation_repair.digests(conversation_repair.repair(rows, reported))
    original = conversations.select(F.col("conv_id").alias("id")).distinct()
    same = lambda name: F.col("id").eqNullSafe(F.col(name))
    both = original.join(reported, same("conv_id"), "left").join(hashes.withColumnRenamed("conv_id", "hashed"), same("hashed"), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return both.select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are rows whose id is divisible by 100; every seventh id has the next label."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"), label=label)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS other, a.label = v.label AS same, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_sentencepiece,
        op3_jaccard_join,
        op4_warc_audit,
        op5_license_scan,
        op6_decontamination,
        op7_token_counts,
        op8_spotsigs,
        op8_spotsigs_near,
        op9_secret_scan,
        op10_quality,
        op11_token_files,
        op12_conversation_repair,
        op13_hard_negatives,
    )
}
SQL: dict[str, str] = {"op3_jaccard_join": OP3_SQL, "op4_warc_audit": OP4_SQL, "op6_decontamination": OP6_SQL, "op13_hard_negatives": OP13_SQL}
