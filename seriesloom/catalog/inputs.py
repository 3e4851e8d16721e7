"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.columns import make_month_date
from ..operators.series import Series
from ..plans.panel import Roles
from ..sources.staging import stage
from ..sources.tables import read_table

MEASURES = ["wet", "dry", "m1", "m2", "m3", "m4", "g", "t"]
ROLES = Roles("wet", "dry", "g", ("m1", "m2", "m3", "m4"))
MONTHS = Series.of("entity", ("year", "month"))
EVENTS = Series.of("event_type", ("ts", "event_id"))


# Columns of the given tables. With them no file is opened before the query runs.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = StructType.fromDDL(SCHEMAS[name])
    return read_table(spark, f"{sf_dir}/{name}.parquet", schema)


def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's nation. Only the nation table, of fixed
    size, is small by itself; the other joins are left to Spark."""
    customer = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return (
        table(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .withColumnRenamed("n_name", "entity")
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation by month: quantities by order month (wet) and ship month (dry), mean
    price by quantity band (m1..m4), mean discount (g), mean order total (t).

    One scan of the lines: each gives a record for its order month and one for
    its ship month, and both are summed per task before the only shuffle of
    this step. Money is summed in cents, so the sums are exact.
    """
    lines = table(spark, sf_dir, "lineitem").join(
        orders_by_nation(spark, sf_dir).select(
            "o_orderkey", "entity", "o_orderdate", "o_totalprice"
        ),
        F.col("l_orderkey") == F.col("o_orderkey"),
    )
    records = lines.select(
        "entity",
        F.expr(
            "explode(array(named_struct('ordered', true, 'day', o_orderdate),"
            " named_struct('ordered', false, 'day', l_shipdate))) AS at"
        ),
        "l_quantity",
        F.expr("least(4, ceil(l_quantity / 12.5D)) AS band"),
        F.expr("CAST(round(l_extendedprice * 100) AS BIGINT) AS cents"),
        F.expr("CAST(round(l_discount * 100) AS BIGINT) AS discount"),
        F.expr("CAST(round(o_totalprice * 100) AS BIGINT) AS total"),
    )

    def mean(value: str, condition: str, output: str) -> Column:
        chosen = f"CASE WHEN {condition} THEN {value} END"
        return F.expr(f"sum({chosen}) / 100.0D / count({chosen}) AS {output}")

    return records.groupBy(
        "entity", F.year("at.day").alias("year"), F.month("at.day").alias("month")
    ).agg(
        F.expr("sum(CASE WHEN at.ordered THEN l_quantity END) AS wet"),
        F.expr("sum(CASE WHEN NOT at.ordered THEN l_quantity END) AS dry"),
        *[mean("cents", f"at.ordered AND band = {i}", f"m{i}") for i in (1, 2, 3, 4)],
        mean("discount", "at.ordered", "g"),
        mean("total", "at.ordered", "t"),
    )


def dated_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make_month_date(panel(spark, sf_dir))


SOURCES = {
    "rain": ["wet"],
    "soil": ["m1", "m2", "m3", "m4"],
    "et": ["dry"],
    "ndvi": ["g"],
    "temp": ["t"],
}
LAST_YEAR_OF_FIRST_PERIOD = 1997


def sources(spark: SparkSession, sf_dir: str) -> list[dict[str, DataFrame]]:
    """Five sources in two periods, each with its own keys and measures.

    They come from one staged panel, so that ten sources do not mean ten scans
    of the lines. The second period of ``et`` has a date in place of year and
    month.
    """
    staged = stage(panel(spark, sf_dir), "sources")
    first = F.col("year") <= LAST_YEAR_OF_FIRST_PERIOD
    periods = []
    for condition in (first, ~first):
        period = {}
        for name, measures in SOURCES.items():
            present = F.coalesce(*measures).isNotNull()
            period[name] = staged.where(condition & present).select(
                "entity", "year", "month", *measures
            )
        periods.append(period)
    late = make_month_date(periods[1]["et"], output="start_date")
    periods[1]["et"] = late.drop("year", "month")
    return periods


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order status as truth, and three rules that guess it."""

    def rule(low, middle) -> Column:
        return F.when(low, "F").when(middle, "O").otherwise("P")

    price, day = F.col("o_totalprice"), F.dayofmonth("o_orderdate")
    priority = F.col("o_orderpriority")
    return orders_by_nation(spark, sf_dir).select(
        "o_orderkey",
        "entity",
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderstatus").alias("true_label"),
        rule(price < 170000, price < 340000).alias("lstm_pred"),
        rule(priority.isin("1-URGENT", "2-HIGH"), priority == "3-MEDIUM").alias("rf_pred"),
        rule(day <= 10, day <= 20).alias("xgb_pred"),
    )


def round_columns(df: DataFrame, columns, digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
