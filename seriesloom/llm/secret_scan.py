"""Secret scan with corpus-wide ownership frequency, in native expressions only.

Every text is searched for base spans (assignments, access keys, hexadecimal runs)
and for further candidates: private keys, keys with a vendor's prefix, and
long mixed words. The values found are hashed and aggregated over the whole corpus
by distinct repositories and owners. A value that ``COPIED_OWNERS`` owners or more
carry is a widely copied example; one of fewer owners that also looks live (enough
distinct characters) belongs to its owner. ``redact`` trusts this less: it leaves a copied
value only if it has an example's marker (``EXAMPLE``), or if more than ``COPIED_SHARE``
of all owners carry it and it does not look live; it redacts all access keys, private
keys and vendors' keys. Base spans are always reported. A long
mixed word becomes a span if its value is a credential's anywhere in the corpus, or
if it looks live and is its owner's; other further candidates are always spans.

Positions are code points, ends exclusive. Matches are leftmost and do not overlap
within a kind: the pieces between matches and the matches give the offsets.

Null and empty texts have no spans. A null owner is an owner of its own, likewise
a null repository. Repeated rows are rows of their own, but one repository. Extra
columns are ignored.

Very long texts are scanned whole. Of spans that begin at one place the kind listed first comes
first. Repeated rows are scanned each, and count once for their owner. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import stage

# The patterns of the base kinds and the least lengths of their values.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs are maximal, so the least length can be part of the pattern
LEAST = {"assign": 6, "access": 20}
BASE_KINDS = ["assign", "access", "hex"]

# Further kinds, reported behind the base kinds.
# a private key is a span to its END line, or, where that is missing, over the lines of base64 behind its header
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:(?:[^-]++|-(?!----)){0,50}+-----END [A-Z ]*PRIVATE KEY-----|(?:\s*+[A-Za-z0-9+/=]{16,}+){0,500}+)"
)
VENDOR = r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"
MIXED = r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{16,}(?![A-Za-z0-9])"
KINDS = [*BASE_KINDS, "pem", "vendor", "mixed"]

COPIED_OWNERS = 3  # distinct owners from which on a value is an example
COPIED_SHARE = 0.5  # share of all owners above which redaction takes a value for an example
EXAMPLE = r"(?i)example|sample|dummy|placeholder|changeme|your[-_]?(?:api|key|token|secret|password)|x{6,}"
LIVE_CHARACTERS = 10  # distinct characters from which on a value looks live

MARK = "[SECRET]"
SPAN = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"


def matches(text: str, pattern: str, rank: int, value_group: int = 0, least: int = 0) -> Column:
    """Spans of a pattern in column ``text``; ``least`` drops short values after matching."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    # the pieces between matches and the matches themselves alternate, so lengths add up to offsets
    found = f"""
    CASE WHEN {text} RLIKE '{quoted}' THEN
      transform(array(named_struct('m', regexp_extract_all({text}, '{quoted}', 0),
                                   'v', regexp_extract_all({text}, '{quoted}', {value_group}),
                                   'g', transform(split({text}, '{quoted}', -1), x -> bigint(length(x))))), s ->
        aggregate(sequence(0, size(s.m) - 1), named_struct('at', 0L, 'out', cast(array() AS {SPAN})),
          (a, i) -> named_struct(
            'at', a.at + s.g[i] + length(s.m[i]),
            'out', CASE WHEN length(s.v[i]) >= {least}
                        THEN array_append(a.out, named_struct('start', a.at + s.g[i], 'rank', {rank}, 'end', a.at + s.g[i] + length(s.m[i]), 'value', s.v[i]))
                        ELSE a.out END),
          a -> a.out))[0]
    ELSE cast(array() AS {SPAN}) END"""
    return F.expr(found)


def found_in(documents: DataFrame, owner: str, repository: list[str] | None, keep: list[str]) -> DataFrame:
    """Per row: the columns ``keep`` as ``kept``, owner, repository, and the base and further spans."""
    parts = [F.col(c).cast("string") for c in (repository or [owner])]
    text = documents.select(
        F.struct(*keep).alias("kept"),
        F.col(owner).cast("string").alias("owner"),
        F.to_json(F.array(*parts)).alias("repository"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"),
    )
    found = text.select(
        "kept",
        "owner",
        "repository",
        F.concat(
            matches("t", ASSIGN, 0, 2, LEAST["assign"]),
            matches("t", ACCESS, 1, 0, LEAST["access"]),
            matches("t", HEX, 2),
        ).alias("base"),
        F.concat(matches("t", PEM, 3), matches("t", VENDOR, 4), matches("t", MIXED, 5)).alias("further"),
    )
    # a further span inside a base span says nothing new
    more = F.filter("further", lambda m: ~F.exists("base", lambda b: (b["start"] <= m["start"]) & (b["end"] >= m["end"])))
    return found.withColumn("more", F.when(F.size("further") > 0, more).otherwise(F.col("further"))).drop("further")


def numbered(found: DataFrame) -> DataFrame:
    """``found`` written once with row numbers, the same for every reader."""
    return stage(found.select(F.monotonically_increasing_id().alias("row_id"), "*"), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: distinct owners and repositories, and whether a base span holds it."""
    spans = found.select("owner", "repository", F.explode(F.concat("base", "more")).alias("s"))
    distinct = spans.groupBy(F.sha2(F.col("s.value"), 256).alias("value_hash"), "owner", "repository").agg(
        F.max(F.col("s.rank") < len(BASE_KINDS)).alias("credential")
    )  # combined before the shuffle: a value that a third of the rows share is one row per owner and task
    owners = distinct.groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"), F.max("credential").alias("credential"))
    return owners.groupBy("value_hash").agg(
        F.count("*").alias("n_owners"),
        F.sum("repositories").alias("n_repositories"),
        F.max("credential").alias("credential"),
    )


def live(value: Column, least: int = LIVE_CHARACTERS) -> Column:
    return F.size(F.array_distinct(F.split(value, ""))) >= least


def judged(found: DataFrame, copied_owners: int = COPIED_OWNERS, all_owners: DataFrame | None = None) -> DataFrame:
    """Per row of numbered ``found`` that has any: its reported spans with classes, n_live, n_copied.

    Spans are structs of start, rank (the kind's place in KINDS), end, class and value_hash,
    in order of start, then kind. ``n_live`` counts owner-specific live-looking spans,
    ``n_copied`` those of widely copied values; class is live, copied or plain. With ``all_owners`` (one row, n_all) a span has the class copied only
    if redaction leaves it.
    """
    spans = found.select("row_id", F.explode(F.concat("base", "more")).alias("s")).select(
        "row_id", "s", F.sha2(F.col("s.value"), 256).alias("value_hash")
    )
    known = spans.join(ownership(found), "value_hash")
    copied = F.col("n_owners") >= copied_owners
    is_live = ~copied & live(F.col("s.value"))
    base = F.col("s.rank") < len(BASE_KINDS)
    kept = base | (F.col("s.rank") < KINDS.index("mixed")) | F.col("credential") | is_live
    left = copied
    if all_owners is not None:
        known = known.crossJoin(F.broadcast(all_owners))
        always = F.col("s.rank").isin([KINDS.index(k) for k in ("access", "pem", "vendor")])
        common = (F.col("n_owners") > COPIED_SHARE * F.col("n_all")) & ~live(F.col("s.value"))
        left = copied & ~always & (F.col("s.value").rlike(EXAMPLE) | common)
    classes = F.when(left, "copied").when(is_live, "live").otherwise("plain")
    span = F.struct(F.col("s.start").alias("start"), F.col("s.rank").alias("rank"), F.col("s.end").alias("end"), classes.alias("class"), "value_hash")
    return (
        known.where(kept)
        .groupBy("row_id")
        .agg(F.sort_array(F.collect_list(span)).alias("spans"), F.count_if(is_live).alias("n_live"), F.count_if(copied).alias("n_copied"))
    )


def scan(documents: DataFrame, owner: str = "source", repository: list[str] | None = None, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Per row of ``documents``: doc_id and what ``judged`` gives, empty and 0 without spans."""
    found = numbered(found_in(documents, owner, repository, ["doc_id"]))
    per_row = judged(found, copied_owners)
    none = F.expr("cast(array() AS array<struct<start:bigint,rank:int,end:bigint,class:string,value_hash:string>>)")
    return (
        found.select("row_id", "kept.doc_id")
        .join(per_row, "row_id", "left")
        .select(
            "doc_id",
            F.coalesce("spans", none).alias("spans"),
            F.coalesce("n_live", F.lit(0)).alias("n_live"),
            F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        )
    )


def redact(documents: DataFrame, owner: str = "source", repository: list[str] | None = None, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """``documents`` with every span in ``text`` but those of copied values that are plainly examples replaced by ``[SECRET]``.

    Only rows with spans are written and joined; all others pass through. Overlapping
    spans become one mark.
    """
    columns = documents.columns
    found = found_in(documents, owner, repository, columns)
    has = F.size("base") + F.size("more") > 0
    clean = found.where(~has).select("kept.*")
    hits = numbered(found.where(has))
    all_owners = documents.select(F.col(owner).cast("string")).distinct().agg(F.count(F.lit(1)).alias("n_all"))
    spans = judged(hits, copied_owners, all_owners).select("row_id", F.filter("spans", lambda s: s["class"] != "copied").alias("cut"))
    joined = hits.select("row_id", "kept").join(spans, "row_id", "left")
    text = F.expr(
        f"""CASE WHEN size(cut) > 0 THEN aggregate(cut, named_struct('at', 0L, 'out', ''),
              (a, s) -> named_struct('at', greatest(a.at, s.end), 'out',
                CASE WHEN s.start >= a.at THEN concat(a.out, substring(kept.text, int(a.at) + 1, int(s.start - a.at)), '{MARK}') ELSE a.out END),
              a -> concat(a.out, substring(kept.text, int(a.at) + 1))) ELSE kept.text END"""
    )
    redacted = joined.select(*[text.alias(c) if c == "text" else F.col(f"kept.`{c}`").alias(c) for c in columns])
    return clean.unionByName(redacted)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the query from those of ``scan``."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    return scanned.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        "n_live",
        "n_copied",
    )
