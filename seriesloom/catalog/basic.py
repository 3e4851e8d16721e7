"""Sources, sinks, projections, filters, joins, sorts, reshaping, encodings, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns as cols
from ..operators import encode, merge, ordering, split, windows
from ..plans import panel as plans
from ..sources.staging import stage, staging_path
from ..sources.tables import read_many, read_table, row_count, row_counts, write_table
from . import sql
from .inputs import (
    LAST_YEAR_OF_FIRST_PERIOD,
    MEASURES,
    MONTHS,
    ROLES,
    SOURCES,
    dated_panel,
    panel,
    round_columns,
    sources,
    table,
)
from .registry import query


P = f"WITH {sql.PANEL}"
O = f"WITH {sql.ORDERS}"
KEYS = "entity, year, month"


# Sources and sinks


@query("scan_table", "SELECT * FROM part")
def scan_table(spark, sf_dir):
    return table(spark, sf_dir, "part")


def source_columns(name: str) -> str:
    return " OR ".join(f"{m} IS NOT NULL" for m in SOURCES[name])


SCAN_COUNTS = " UNION ALL ".join(
    f"""SELECT '{name}' AS variable, {p} AS period, count(*) AS rows FROM panel
    WHERE ({source_columns(name)}) AND year {test}"""
    for name in SOURCES
    for p, test in ((1, "<= 1997"), (2, "> 1997"))
)


@query("scan_many", f"{P} {SCAN_COUNTS}")
def scan_many(spark, sf_dir):
    """Write ten source tables, read them by key, count each."""
    root = staging_path(spark, "scan_many")
    paths = {}
    for period, tables in enumerate(sources(spark, sf_dir), start=1):
        for name, df in tables.items():
            paths[name, period] = write_table(df, f"{root}/{name}_{period}")
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("variable"), F.lit(period).alias("period"), "rows"
        )
        for (name, period), df in read_many(spark, paths).items()
    ]
    return merge.union_by_name(counts)


@query("sink_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def sink_table(spark, sf_dir):
    """A table through CSV and back."""
    df = table(spark, sf_dir, "customer")
    path = write_table(df, staging_path(spark, "sink") + ".csv")
    return read_table(spark, path, df.schema)


@query("row_count", "SELECT count(*) AS rows, 11 AS columns FROM lineitem")
def rows_and_columns(spark, sf_dir):
    return row_count(table(spark, sf_dir, "lineitem"))


# Projections and filters


RAW_KEY = "concat('  ', p_name, '''', p_type, ' ', p_brand, '-x ', chr(9))"


@query(
    "normalize_key",
    f"""WITH k AS (SELECT p_partkey, regexp_replace({RAW_KEY}, '^\\s+|\\s+$', '', 'g') AS k FROM part)
    SELECT p_partkey, {sql.title_case("k")} AS key FROM k""",
)
def normalize_key(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    raw = F.concat(
        F.lit("  "), "p_name", F.lit("'"), "p_type", F.lit(" "), "p_brand", F.lit("-x \t")
    )
    return cols.normalize_key(df.select("p_partkey", raw.alias("key")), "key")


@query(
    "normalize_key_missing",
    """SELECT event_id, CASE WHEN value > 50 THEN upper(event_type[1]) || lower(event_type[2:])
    ELSE 'Nan' END AS key FROM events""",
)
def normalize_key_missing(spark, sf_dir):
    key = F.when(F.col("value") > 50, F.upper("event_type"))
    df = table(spark, sf_dir, "events").select("event_id", key.alias("key"))
    return cols.normalize_key(df, "key")


@query(
    "split_date",
    "SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month FROM orders",
)
def split_date(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("start_date"))
    return cols.split_date(df)


@query("make_month_date", f"{P} SELECT {KEYS}, date FROM panel")
def make_month_date(spark, sf_dir):
    return dated_panel(spark, sf_dir).select("entity", "year", "month", "date")


@query("parse_date", "SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS day FROM lineitem")
def parse_date(spark, sf_dir):
    text = F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text)
    return cols.parse_date(df, "day", "yyyy-MM-dd")


@query(
    "cyclic_encode",
    """SELECT o_orderkey, round(sin(2 * pi() * month(o_orderdate) / 12), 9) AS month_sin,
    round(cos(2 * pi() * month(o_orderdate) / 12), 9) AS month_cos FROM orders""",
)
def cyclic_encode(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.month("o_orderdate").alias("month"))
    encoded = cols.cyclic_encode(df, "month").drop("month")
    return round_columns(encoded, ["month_sin", "month_cos"], 9)


@query(
    "drop_null_rows",
    f"{P} SELECT * FROM panel WHERE " + " AND ".join(f"{m} IS NOT NULL" for m in MEASURES),
)
def drop_null_rows(spark, sf_dir):
    return cols.drop_null_rows(dated_panel(spark, sf_dir))


@query("drop_null_subset", f"{P} SELECT * FROM panel WHERE wet IS NOT NULL AND g IS NOT NULL")
def drop_null_subset(spark, sf_dir):
    return cols.drop_null_subset(dated_panel(spark, sf_dir), ["wet", "g"])


@query("drop_if_exists", "SELECT s_suppkey, s_nationkey FROM supplier")
def drop_if_exists(spark, sf_dir):
    return cols.drop_if_exists(table(spark, sf_dir, "supplier"), ["s_name", "s_acctbal", "spi_3"])


@query(
    "drop_columns_like",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem",
)
def drop_columns_like(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return cols.drop_columns_like(cols.drop_columns_like(df, "line"), "date")


@query(
    "select_features",
    "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
)
def select_features(spark, sf_dir):
    exclude = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"]
    return cols.select_features(table(spark, sf_dir, "lineitem"), exclude)


@query(
    "align_to_schema",
    "SELECT p_retailprice, 0::DOUBLE AS p_absent, p_size, p_partkey FROM part",
)
def align_to_schema(spark, sf_dir):
    order = ["p_retailprice", "p_absent", "p_size", "p_partkey"]
    return cols.align_to_schema(table(spark, sf_dir, "part"), order)


@query(
    "cast_columns",
    "SELECT doc_id, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic FROM labels",
)
def cast_columns(spark, sf_dir):
    return cols.cast_columns(table(spark, sf_dir, "labels"), ["quality", "toxic"])


@query(
    "filter_isin",
    "SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders WHERE year(o_orderdate) IN (1996, 1998, 2000)",
)
def filter_isin(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return cols.filter_isin(df, "year", [1996, 1998, 2000])


@query("filter_eq", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq(spark, sf_dir):
    return cols.filter_eq(table(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING")


@query("flag_correct", "SELECT doc_id, quality = toxic AS correct FROM labels")
def flag_correct(spark, sf_dir):
    return cols.flag_correct(table(spark, sf_dir, "labels"), "quality", "toxic").select(
        "doc_id", "correct"
    )


@query(
    "map_values",
    """SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 1.5::DOUBLE
    WHEN 'view' THEN 0.5::DOUBLE WHEN 'purchase' THEN 4::DOUBLE END AS weight FROM events""",
)
def map_values(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    return cols.map_values(df, "event_type", {"click": 1.5, "view": 0.5, "purchase": 4}, "weight")


@query(
    "argmax_class",
    "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best FROM embeddings",
)
def argmax_class(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return df.select("vec_id", cols.argmax_class(F.col("embedding")).alias("best"))


@query("distinct_values", "SELECT DISTINCT lang, source FROM documents")
def distinct_values(spark, sf_dir):
    return cols.distinct_values(table(spark, sf_dir, "documents"), ["lang", "source"])


# Joins, unions, reshaping


@query("outer_merge_many", f"{P} SELECT {KEYS}, {', '.join(MEASURES)} FROM panel")
def outer_merge_many(spark, sf_dir):
    first, second = sources(spark, sf_dir)
    second = {name: cols.split_date(df) for name, df in second.items()}
    keys = ["entity", "year", "month"]
    return merge.union_by_name(
        [merge.outer_merge_many(list(p.values()), keys) for p in (first, second)]
    )


@query("outer_merge_stacked", f"{P} SELECT {KEYS}, {', '.join(MEASURES)} FROM panel")
def outer_merge_stacked(spark, sf_dir):
    first, second = sources(spark, sf_dir)
    second = {name: cols.split_date(df) for name, df in second.items()}
    keys = ["entity", "year", "month"]
    return merge.union_by_name(
        [merge.outer_merge_many(list(p.values()), keys, "stack") for p in (first, second)]
    )


@query(
    "outer_merge_repeated_keys",
    """SELECT coalesce(o_orderkey, l_orderkey) AS order_key, o_totalprice, l_linenumber, l_quantity
    FROM orders FULL JOIN lineitem ON o_orderkey = l_orderkey""",
)
def outer_merge_repeated_keys(spark, sf_dir):
    """Lines repeat their order's key."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")
    return merge.outer_merge_many(
        [
            orders.select(F.col("o_orderkey").alias("order_key"), "o_totalprice"),
            lines.select(F.col("l_orderkey").alias("order_key"), "l_linenumber", "l_quantity"),
        ],
        ["order_key"],
    )


@query(
    "lookup_join",
    "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
def lookup_join(spark, sf_dir):
    joined = merge.lookup_join(
        table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), "s_nationkey", "n_nationkey"
    )
    return joined.select("s_suppkey", "s_name", "n_name")


@query("scalar_lookup", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def scalar_lookup(spark, sf_dir):
    return merge.scalar_lookup(table(spark, sf_dir, "nation"), "n_nationkey", 7, "n_name")


@query(
    "align_predictions",
    """SELECT o.o_orderkey, o_orderstatus AS true_label,
    CASE WHEN o_totalprice < 250000 THEN 'F' ELSE 'O' END AS a_pred, m.b_pred
    FROM orders o LEFT JOIN (SELECT l_orderkey, CASE WHEN sum(l_quantity) > 100 THEN 'P' ELSE 'F' END AS b_pred
      FROM lineitem GROUP BY l_orderkey) m ON o.o_orderkey = m.l_orderkey""",
)
def align_predictions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    a = orders.select("o_orderkey", F.expr("CASE WHEN o_totalprice < 250000 THEN 'F' ELSE 'O' END AS prediction"))
    quantity = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    b = quantity.agg(F.when(F.sum("l_quantity") > 100, "P").otherwise("F").alias("prediction"))
    truth = orders.select("o_orderkey", F.col("o_orderstatus").alias("true_label"))
    return merge.align_predictions(truth, {"a_pred": a, "b_pred": b}, "o_orderkey")


@query(
    "union_by_name",
    """SELECT c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_nationkey, s_acctbal, NULL FROM supplier""",
)
def union_by_name(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")
    )
    return merge.union_by_name([customer, supplier])


@query(
    "hconcat",
    """SELECT c_custkey, c_acctbal, (c_mktsegment = 'BUILDING')::INT AS is_building,
    (c_mktsegment = 'MACHINERY')::INT AS is_machinery FROM customer""",
)
def hconcat(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    flags = {f"is_{s.lower()}": (F.col("c_mktsegment") == s).cast("int") for s in ("BUILDING", "MACHINERY")}
    return cols.hconcat(df.select("c_custkey", "c_acctbal", "c_mktsegment"), flags).drop("c_mktsegment")


@query(
    "melt",
    " UNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, '{c}' AS metric, {c} AS score FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_tax")
    ),
)
def melt(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return merge.melt(
        df, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "metric", "score"
    )


# Sorts and first rows


@query("sort_panel", f"{P} SELECT * FROM panel ORDER BY {KEYS}")
def sort_panel(spark, sf_dir):
    return ordering.sort_panel(dated_panel(spark, sf_dir), ["entity", "year", "month"])


@query("sort_by_date", "SELECT o_orderkey, o_orderdate::DATE AS date FROM orders ORDER BY date, o_orderkey")
def sort_by_date(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return ordering.sort_panel(df, ["date", "o_orderkey"])


@query("head_n", "SELECT * FROM customer ORDER BY c_custkey LIMIT 20")
def head_n(spark, sf_dir):
    return ordering.head_n(table(spark, sf_dir, "customer"), 20, "c_custkey")


# Encodings


@query(
    "label_encode",
    """SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS code FROM customer""",
)
def label_encode(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    classes = encode.label_classes(df, "c_mktsegment")
    return encode.label_encode(df, "c_mktsegment", "code", classes).select("c_custkey", "code")


@query(
    "label_encode_names",
    "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_name) - 1)::INT AS code FROM customer",
)
def label_encode_names(spark, sf_dir):
    """As many labels as rows."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    classes = encode.label_classes(df, "c_name")
    return encode.label_encode(df, "c_name", "code", classes).select("c_custkey", "code")


@query("label_decode", "SELECT c_custkey, c_mktsegment AS label FROM customer")
def label_decode(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    classes = encode.label_classes(df, "c_mktsegment")
    encoded = encode.label_encode(df, "c_mktsegment", "code", classes).select("c_custkey", "code")
    return encode.label_decode(encoded, "code", "label", classes).select("c_custkey", "label")


SEGMENTS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "one_hot_encode",
    "SELECT c_custkey, "
    + ", ".join(f"(c_mktsegment = '{s}')::DOUBLE AS \"c_mktsegment_{s}\"" for s in SEGMENTS)
    + " FROM customer",
)
def one_hot_encode(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return encode.one_hot_encode(df, "c_mktsegment")


@query(
    "standard_scale",
    """WITH s AS (SELECT avg(p_size) AS ms, stddev_pop(p_size) AS ds, avg(p_retailprice) AS mp,
    stddev_pop(p_retailprice) AS dp FROM part)
    SELECT p_partkey, round((p_size - ms) / ds, 6) AS p_size_scaled,
    round((p_retailprice - mp) / dp, 6) AS p_retailprice_scaled FROM part, s""",
)
def standard_scale(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    scaled = encode.standard_scale(df, ["p_size", "p_retailprice"]).drop("p_size", "p_retailprice")
    return round_columns(scaled, ["p_size_scaled", "p_retailprice_scaled"], 6)


# Splits


def with_roles(parts):
    named = [p.withColumn("role", F.lit(r)) for p, r in zip(parts, ("train", "test"))]
    return merge.union_by_name(named)


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("date"), F.year("o_orderdate").alias("year")
    )


ORDER_DATES = "SELECT o_orderkey, o_orderdate::DATE AS date FROM orders"


@query(
    "split_years",
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) <= 1999 THEN 'train' ELSE 'test' END AS role
    FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2000""",
)
def split_years(spark, sf_dir):
    parts = split.split_years(orders(spark, sf_dir), range(1995, 2000), [2000])
    return with_roles(parts).select("o_orderkey", "role")


@query(
    "split_date_cut",
    f"""SELECT o_orderkey, CASE WHEN date < DATE '2000-01-01' THEN 'train' ELSE 'test' END AS role
    FROM ({ORDER_DATES})""",
)
def split_date_cut(spark, sf_dir):
    return with_roles(split.split_date_cut(orders(spark, sf_dir), "2000-01-01")).select(
        "o_orderkey", "role"
    )


@query(
    "split_ratio",
    f"""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY date, o_orderkey)
    <= floor((SELECT count(*) FROM orders) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS role
    FROM ({ORDER_DATES})""",
)
def split_ratio(spark, sf_dir):
    parts = split.split_ratio(orders(spark, sf_dir), ["date", "o_orderkey"], 0.8)
    return with_roles(parts).select("o_orderkey", "role")


@query(
    "timeseries_folds",
    f"""WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY date, o_orderkey) AS pos,
      count(*) OVER () AS n FROM ({ORDER_DATES})),
    f AS (SELECT *, n - (6 - fold) * (n // 6) AS first, n // 6 AS size
      FROM p, (SELECT unnest([1, 2, 3, 4, 5])::INT AS fold))
    SELECT o_orderkey, fold, CASE WHEN pos > first THEN 'test' ELSE 'train' END AS role
    FROM f WHERE pos <= first + size""",
)
def timeseries_folds(spark, sf_dir):
    folds = split.timeseries_folds(orders(spark, sf_dir), ["date", "o_orderkey"], 5)
    return folds.select("o_orderkey", "fold", "role")


# Composites


MERGED_PANEL = (
    f"{sql.PANEL}, named AS (SELECT * REPLACE ({sql.title_case('entity')} AS entity) FROM panel),"
    + sql.interpolation("named", "filled", "entity", "year, month", MEASURES)
)
MONTHLY = "OVER (PARTITION BY entity ORDER BY year, month"


def features_sql() -> str:
    def last(k: int) -> str:
        return f"{MONTHLY} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"

    soil = ("m1", "m2", "m3", "m4")
    chain = "balance AS (SELECT *, wet - dry AS b FROM filled)"
    source = "balance"
    for value, name in (("wet", "spi"), ("b", "spei")):
        for k in (3, 6):
            out = f"{name}_{k}"
            chain += "," + sql.gamma_index(source, f"x_{out}", "entity", "year, month", value, k, out)
            source = f"x_{out}"
    pct = ", ".join(
        f"(rank() OVER (PARTITION BY entity ORDER BY {c}) + count(*) OVER (PARTITION BY entity"
        f" ORDER BY {c} RANGE UNBOUNDED PRECEDING)) * 50::DOUBLE / count(*) OVER (PARTITION BY entity) AS {c}_pct"
        for c in soil
    )
    lags = ", ".join(
        f"lag({c}, {n}) {MONTHLY}) AS {c}_lag{n}" for c in ("wet", "g", "m1", "dry") for n in (1, 2, 3)
    )
    rolls = ", ".join(f"avg({c}) {last(3)} AS {c}_roll3" for c in ("g", *soil, "wet"))
    return f"""{MERGED_PANEL}, {chain},
    classed AS (SELECT *, CASE WHEN spei_3 <= -1.5 THEN 'Extreme' WHEN spei_3 <= -1.0 THEN 'Moderate'
      ELSE 'No Drought' END AS drought_class FROM {source}),
    wide AS (SELECT {KEYS}, date, wet, dry, m1, m2, m3, m4, g, t, spi_3, spi_6, spei_3, spei_6,
      drought_class, lead(drought_class, 3) {MONTHLY}) AS future_drought_class, {lags}, {rolls},
      avg(wet) {last(6)} AS wet_roll6,
      (g - avg(g) OVER (PARTITION BY entity)) / nullif(stddev_samp(g) OVER (PARTITION BY entity), 0)
        AS g_anomaly, {pct} FROM classed),
    features AS (SELECT * FROM wide WHERE COLUMNS(*) IS NOT NULL)"""


LAGGED = [f"{c}_lag{n}" for c in ("wet", "g", "m1", "dry") for n in (1, 2, 3)]
SMOOTH = [f"{c}_roll3" for c in ("g", "m1", "m2", "m3", "m4", "wet")] + ["wet_roll6"]
PCT = ["m1_pct", "m2_pct", "m3_pct", "m4_pct"]
INDEX = ["spi_3", "spi_6", "spei_3", "spei_6"]
# only what is computed in floating point; measures and their lags are exact
FEATURE_DIGITS = (
    {c: 5 for c in SMOOTH}
    | {"g_roll3": 8, "g_anomaly": 6}
    | {c: 6 for c in PCT}
    | {c: 4 for c in INDEX}
)


def nudge(digits: int) -> float:
    """Added before rounding: decimal ties are common in means of prices, and the
    two engines break them by different rules."""
    return 10.0 ** -(digits + 2)


def rounded_features(names) -> str:
    def one(c: str) -> str:
        if c not in FEATURE_DIGITS:
            return c
        d = FEATURE_DIGITS[c]
        return f"round({c} + {nudge(d)!r}::DOUBLE, {d}) AS {c}"

    return ", ".join(map(one, names))


def round_features(df):
    return df.withColumns(
        {c: F.round(F.col(c) + nudge(d), d) for c, d in FEATURE_DIGITS.items() if c in df.columns}
    )


FEATURES = f"WITH {features_sql()}"
NUMBERS = [*MEASURES, *LAGGED, *SMOOTH, "g_anomaly", *PCT]
READY = f"""{FEATURES}, ready AS (SELECT {KEYS}, date, future_drought_class,
    {rounded_features(NUMBERS)}, round(sin(2 * pi() * month / 12), 9) AS month_sin,
    round(cos(2 * pi() * month / 12), 9) AS month_cos, """ + ", ".join(
    f"lead(future_drought_class, {n}) {MONTHLY}) AS target_{n}m_ahead" for n in (1, 2, 3)
) + """ FROM features) SELECT * FROM ready WHERE target_3m_ahead IS NOT NULL"""


@query("merge_panel", f"WITH {MERGED_PANEL} SELECT {KEYS}, {', '.join(MEASURES)} FROM filled")
def merge_panel(spark, sf_dir):
    return plans.merge_panel(sources(spark, sf_dir), how="join")


SOURCE_ROWS = " UNION ALL ".join(
    f"SELECT 'period {i} {name}' AS stage, count(*) AS rows FROM panel WHERE coalesce({', '.join(measures)}) IS NOT NULL AND year {sign} {LAST_YEAR_OF_FIRST_PERIOD}"
    for i, sign in ((1, "<="), (2, ">"))
    for name, measures in SOURCES.items()
)
PERIOD_ROWS = " UNION ALL ".join(
    f"SELECT '{stage}', count(*) FROM filled WHERE {condition}"
    for stage, condition in (
        ("period 1", f"year <= {LAST_YEAR_OF_FIRST_PERIOD}"), ("period 2", f"year > {LAST_YEAR_OF_FIRST_PERIOD}"), ("panel", "true")
    )
)


@query("merge_panel_counts", f"WITH {MERGED_PANEL} {SOURCE_ROWS} UNION ALL {PERIOD_ROWS}")
def merge_panel_counts(spark, sf_dir):
    """Rows of every source, period and the panel, counted while the panel is written."""
    counts = {}
    stage(plans.merge_panel(sources(spark, sf_dir), how="join", counts=counts), "panel")
    return row_counts(spark, counts)


def clean_panel(spark, sf_dir):
    named = cols.normalize_key(panel(spark, sf_dir), "entity")
    return windows.interpolate_linear(named, MONTHS, MEASURES)


@query(
    "build_features",
    f"""{FEATURES} SELECT {KEYS}, date, drought_class, future_drought_class,
    {rounded_features([*NUMBERS, *INDEX])} FROM features""",
)
def build_features(spark, sf_dir):
    return round_features(plans.build_features(clean_panel(spark, sf_dir), ROLES))


def round_ready(df):
    return round_columns(round_features(df), ["month_sin", "month_cos"], 9)


@query("build_model_ready", READY)
def build_model_ready(spark, sf_dir):
    features = plans.build_features(clean_panel(spark, sf_dir), ROLES)
    return round_ready(plans.build_model_ready(features, ROLES))


@query("model_ready_end_to_end", READY)
def model_ready_end_to_end(spark, sf_dir):
    return round_ready(plans.model_ready(sources(spark, sf_dir), ROLES, how="stack"))
