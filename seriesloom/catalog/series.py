"""Window operators, over the monthly panel and over single events.

The panel has one row per nation and month: plain windows. Events have no such
bound (one event type may hold any share of the rows): chunked series.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import indices, windows
from ..operators.series import Series, chunked
from . import sql
from .inputs import EVENTS, MEASURES, MONTHS, dated_panel, panel, round_columns, table
from .registry import SQL, query

P = f"WITH {sql.PANEL}"
KEYS = "entity, year, month"
OVER = "OVER (PARTITION BY entity ORDER BY year, month"
# measures filled, as the features expect them
FILLED = sql.interpolation("panel", "filled", "entity", "year, month", MEASURES)


def last(k: int) -> str:
    return f"{OVER} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


@query(
    "interpolate_linear",
    f"{P}, {FILLED} SELECT {KEYS}, {', '.join(MEASURES)} FROM filled",
)
def interpolate_linear(spark, sf_dir):
    return windows.interpolate_linear(panel(spark, sf_dir), MONTHS, MEASURES)


@query(
    "rolling_sum",
    f"""{P} SELECT {KEYS},
    CASE WHEN count(wet) {last(3)} = 3 THEN sum(wet) {last(3)} END AS wet_sum3,
    CASE WHEN count(dry) {last(3)} = 3 THEN sum(dry) {last(3)} END AS dry_sum3 FROM panel""",
)
def rolling_sum(spark, sf_dir):
    df = panel(spark, sf_dir).select("entity", "year", "month", "wet", "dry")
    df = windows.rolling_sum(df, MONTHS, {"wet_sum3": "wet", "dry_sum3": "dry"}, 3)
    return df.drop("wet", "dry")


@query(
    "rolling_mean",
    f"""{P} SELECT {KEYS}, round(avg(wet) {last(3)}, 6) AS wet_roll3,
    round(avg(wet) {last(6)}, 6) AS wet_roll6, round(avg(g) {last(3)}, 6) AS g_roll3
    FROM panel""",
)
def rolling_mean(spark, sf_dir):
    df = panel(spark, sf_dir).select("entity", "year", "month", "wet", "g")
    df = windows.rolling_mean(df, MONTHS, {"wet_roll3": "wet", "g_roll3": "g"}, 3)
    df = windows.rolling_mean(df, MONTHS, {"wet_roll6": "wet"}, 6)
    return round_columns(df, ["wet_roll3", "wet_roll6", "g_roll3"], 6).drop("wet", "g")


@query(
    "lag_features",
    f"{P} SELECT {KEYS}, "
    + ", ".join(f"lag({c}, {n}) {OVER}) AS {c}_lag{n}" for c in ("wet", "g", "m1", "dry") for n in (1, 2, 3))
    + " FROM panel",
)
def lag_features(spark, sf_dir):
    columns = ["wet", "g", "m1", "dry"]
    df = panel(spark, sf_dir).select("entity", "year", "month", *columns)
    return windows.lag_features(df, MONTHS, columns).drop(*columns)


WETNESS = "CASE WHEN wet < 1500 THEN 'low' WHEN wet < 2500 THEN 'middle' ELSE 'high' END"


def wetness(spark, sf_dir):
    df = panel(spark, sf_dir)
    return df.select("entity", "year", "month", F.expr(WETNESS).alias("class"))


@query(
    "lead_target",
    f"{P} SELECT {KEYS}, {WETNESS} AS class, lead({WETNESS}, 3) {OVER}) AS future_class FROM panel",
)
def lead_target(spark, sf_dir):
    return windows.lead_target(wetness(spark, sf_dir), MONTHS, "class", 3, "future_class")


@query(
    "multi_horizon_targets",
    f"{P}, ahead AS (SELECT {KEYS}, lead({WETNESS}, 3) {OVER}) AS future_class FROM panel) "
    f"SELECT {KEYS}, future_class, "
    + ", ".join(f"lead(future_class, {n}) {OVER}) AS target_{n}m_ahead" for n in (1, 2, 3))
    + " FROM ahead",
)
def multi_horizon_targets(spark, sf_dir):
    df = windows.lead_target(wetness(spark, sf_dir), MONTHS, "class", 3, "future_class")
    return windows.multi_horizon_targets(df.drop("class"), MONTHS, "future_class")


@query(
    "zscore_anomaly",
    f"""{P}, s AS (SELECT *, avg(g) OVER (PARTITION BY entity) AS m,
    stddev_samp(g) OVER (PARTITION BY entity) AS d FROM panel)
    SELECT {KEYS}, round((g - m) / CASE WHEN d > 0 THEN d END, 6) AS g_anomaly FROM s""",
)
def zscore_anomaly(spark, sf_dir):
    df = panel(spark, sf_dir).select("entity", "year", "month", "g")
    df = windows.zscore_anomaly(df, MONTHS, {"g_anomaly": "g"})
    return round_columns(df, ["g_anomaly"], 6).drop("g")


def percentile_sql(source: str, entity: str, keys: str, columns) -> str:
    parts = []
    for c in columns:
        below = f"(SELECT count(*) FROM v WHERE v.{entity} = x.{entity} AND v.{c} < x.{c})"
        upto = f"(SELECT count(*) FROM v WHERE v.{entity} = x.{entity} AND v.{c} <= x.{c})"
        n = f"(SELECT count({c}) FROM v WHERE v.{entity} = x.{entity})"
        parts.append(
            f"CASE WHEN {c} IS NOT NULL THEN ({below} + {upto} + 1) * 50::DOUBLE / {n} END AS {c}_pct"
        )
    return f", v AS (SELECT * FROM {source}) SELECT {keys}, {', '.join(parts)} FROM v x"


@query(
    "percentile_of_score",
    f"{P}" + percentile_sql("panel", "entity", KEYS, ["m1", "m2", "m3", "m4"]),
)
def percentile_of_score(spark, sf_dir):
    bands = ["m1", "m2", "m3", "m4"]
    df = panel(spark, sf_dir).select("entity", "year", "month", *bands)
    return windows.percentile_of_score(df, MONTHS, {f"{c}_pct": c for c in bands}).drop(*bands)


def positive_sums(k: int) -> str:
    return f"sums AS (SELECT *, CASE WHEN count(wet) {last(k)} = {k} THEN sum(wet) {last(k)} END + 0.01::DOUBLE AS x FROM panel)"


@query(
    "gamma_fit",
    f"""{P}, {positive_sums(3)}, {sql.gamma_fits("sums", "fits", "entity", "x", 3)}
    SELECT entity, n, round(mean, 4) AS mean, round(shape, 4) AS shape, round(scale, 4) AS scale
    FROM fits""",
)
def gamma_fit(spark, sf_dir):
    df = panel(spark, sf_dir).select("entity", "year", "month", "wet")
    df = windows.rolling_sum(df, MONTHS, {"x": "wet"}, 3).withColumn("x", F.col("x") + indices.OFFSET)
    return round_columns(indices.gamma_fit(df, "entity", "x", 3), ["mean", "shape", "scale"], 4)


@query(
    "spi",
    f"""{P}, {FILLED},
    {sql.gamma_index("filled", "i3", "entity", "year, month", "wet", 3, "spi_3")},
    {sql.gamma_index("i3", "i6", "entity", "year, month", "wet", 6, "spi_6")}
    SELECT {KEYS}, {sql.rounded(["spi_3", "spi_6"], 4)} FROM i6""",
)
def spi(spark, sf_dir):
    df = panel(spark, sf_dir).select("entity", "year", "month", "wet")
    df = windows.interpolate_linear(df, MONTHS, ["wet"])
    wet = F.col("wet")
    df = indices.standardised_indices(df, MONTHS, {"spi_3": (wet, 3), "spi_6": (wet, 6)})
    return round_columns(df, ["spi_3", "spi_6"], 4).drop("wet")


@query(
    "spei",
    f"""{P}, {FILLED}, balance AS (SELECT *, wet - dry AS b FROM filled),
    {sql.gamma_index("balance", "i3", "entity", "year, month", "b", 3, "spei_3")},
    {sql.gamma_index("i3", "i6", "entity", "year, month", "b", 6, "spei_6")}
    SELECT {KEYS}, {sql.rounded(["spei_3", "spei_6"], 4)} FROM i6""",
)
def spei(spark, sf_dir):
    df = panel(spark, sf_dir).select("entity", "year", "month", "wet", "dry")
    df = windows.interpolate_linear(df, MONTHS, ["wet", "dry"])
    balance = F.col("wet") - F.col("dry")
    df = indices.standardised_indices(df, MONTHS, {"spei_3": (balance, 3), "spei_6": (balance, 6)})
    return round_columns(df, ["spei_3", "spei_6"], 4).drop("wet", "dry")


@query(
    "classify_threshold",
    """SELECT event_id, CASE WHEN 50 - value <= -150 THEN 'Extreme' WHEN 50 - value <= -50
    THEN 'Moderate' ELSE 'No Drought' END AS class FROM events""",
)
def classify_threshold(spark, sf_dir):
    label = indices.classify_threshold(
        F.lit(50.0) - F.col("value"), [(-150.0, "Extreme"), (-50.0, "Moderate")]
    )
    return table(spark, sf_dir, "events").select("event_id", label.alias("class"))


@query(
    "sequence_windows",
    f"""{P}, {FILLED}, w AS (SELECT {KEYS},
    list([wet, g]) {OVER} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS seq FROM filled),
    s AS (SELECT * FROM w WHERE len(seq) = 12)
    SELECT {KEYS}, len(seq)::INT AS steps, round(seq[1][1], 4) AS oldest,
    round(seq[12][1], 4) AS newest,
    round(list_sum(list_transform(seq, lambda x: x[2])), 6) AS g_total FROM s""",
)
def sequence_windows(spark, sf_dir):
    df = panel(spark, sf_dir).select("entity", "year", "month", "wet", "g")
    df = windows.interpolate_linear(df, MONTHS, ["wet", "g"])
    df = windows.sequence_windows(df, MONTHS, ["wet", "g"], 12)
    g_total = F.aggregate("seq", F.lit(0.0), lambda acc, step: acc + step[1])
    return df.select(
        "entity",
        "year",
        "month",
        F.size("seq").alias("steps"),
        F.round(F.col("seq")[0][0], 4).alias("oldest"),
        F.round(F.col("seq")[11][0], 4).alias("newest"),
        F.round(g_total, 6).alias("g_total"),
    )


@query(
    "group_apply",
    f"""{P}, c AS (SELECT *, sum(dry) {OVER}) AS total FROM panel WHERE dry IS NOT NULL)
    SELECT entity, min(make_date(year, month, 1)) FILTER
      (total >= (SELECT sum(dry) / 2 FROM panel p WHERE p.entity = c.entity)) AS half_date
    FROM c GROUP BY entity""",
)
def group_apply(spark, sf_dir):
    """The month in which half of an entity's total was reached."""

    def half(pdf):
        pdf = pdf.sort_values("date")
        reached = pdf[pdf["dry"].cumsum() >= pdf["dry"].sum() / 2]
        return reached[["entity", "date"]].head(1).rename(columns={"date": "half_date"})

    df = dated_panel(spark, sf_dir).where("dry IS NOT NULL").select("entity", "date", "dry")
    return windows.group_apply(df, "entity", half, "entity string, half_date date", 100_000)


@query("group_stream", SQL["group_apply"])
def group_stream(spark, sf_dir):
    """The same month, found batch by batch with the sum so far as state."""
    total = F.sum("dry").over(Window.partitionBy("entity"))
    df = dated_panel(spark, sf_dir).where("dry IS NOT NULL").select("entity", "date", "dry", total.alias("total"))

    def step(state, pdf):
        so_far, done = state
        sums = so_far + pdf["dry"].cumsum()
        found = None
        if not done:
            reached = pdf[sums >= pdf["total"] / 2]
            if len(reached):
                found, done = reached[["entity", "date"]].head(1).rename(columns={"date": "half_date"}), True
        return (sums.iloc[-1], done), found

    return windows.group_stream(df, "entity", "date", lambda key: (0.0, False), step, "entity string, half_date date")


# Single events


V = "gap AS (SELECT *, CASE WHEN value < 60 THEN value END AS v FROM events)"
E_OVER = "OVER (PARTITION BY event_type ORDER BY ts, event_id"


def event_series(spark, sf_dir, *columns) -> tuple:
    """Events by type, cut into ranges; ``v`` lacks the large values."""
    events = table(spark, sf_dir, "events").withColumn("v", F.expr("CASE WHEN value < 60 THEN value END"))
    return chunked(events.select("event_type", "ts", "event_id", *columns), EVENTS)


def e_last(k: int) -> str:
    return f"{E_OVER} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


@query(
    "rolling_events",
    f"""WITH {V} SELECT event_id,
    round(CASE WHEN count(v) {e_last(3)} = 3 THEN sum(v) {e_last(3)} END, 6) AS sum3,
    round(avg(v) {e_last(30)}, 6) AS mean30 FROM gap""",
)
def rolling_events(spark, sf_dir):
    df, series = event_series(spark, sf_dir, "v")
    df = windows.rolling_sum(df, series, {"sum3": "v"}, 3)
    df = windows.rolling_mean(df, series, {"mean30": "v"}, 30)
    return round_columns(df.select("event_id", "sum3", "mean30"), ["sum3", "mean30"], 6)


@query(
    "lag_lead_events",
    f"""SELECT event_id, lag(value, 1) {E_OVER}) AS value_lag1, lag(value, 2) {E_OVER}) AS value_lag2,
    lag(value, 3) {E_OVER}) AS value_lag3, lead(value, 3) {E_OVER}) AS ahead FROM events""",
)
def lag_lead_events(spark, sf_dir):
    df, series = event_series(spark, sf_dir, "value")
    df = windows.lag_features(df, series, ["value"])
    df = windows.lead_target(df, series, "value", 3, "ahead")
    return df.select("event_id", "value_lag1", "value_lag2", "value_lag3", "ahead")


@query(
    "interpolate_events",
    f"WITH {V}, "
    + sql.interpolation("gap", "filled", "event_type", "ts, event_id", ["v"])
    + " SELECT event_id, round(v, 6) AS v FROM filled",
)
def interpolate_events(spark, sf_dir):
    df, series = event_series(spark, sf_dir, "v")
    df = windows.interpolate_linear(df, series, ["v"])
    return df.select("event_id", F.round("v", 6).alias("v"))


@query(
    "zscore_events",
    """SELECT event_id, round((value - avg(value) OVER (PARTITION BY event_type))
    / stddev_samp(value) OVER (PARTITION BY event_type), 6) AS z FROM events""",
)
def zscore_events(spark, sf_dir):
    df, series = event_series(spark, sf_dir, "value")
    df = windows.zscore_anomaly(df, series, {"z": "value"})
    return df.select("event_id", F.round("z", 6).alias("z"))


@query(
    "percentile_events",
    """WITH r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY value) AS r,
    count(*) OVER (PARTITION BY event_type ORDER BY value RANGE UNBOUNDED PRECEDING) AS c,
    count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_id, round((r + c) * 50::DOUBLE / n, 6) AS pct FROM r""",
)
def percentile_events(spark, sf_dir):
    df, series = event_series(spark, sf_dir, "value")
    df = windows.percentile_of_score(df, series, {"pct": "value"})
    return df.select("event_id", F.round("pct", 6).alias("pct"))


@query(
    "spi_events",
    f"""WITH {sql.gamma_index("events", "i", "event_type", "ts, event_id", "value", 6, "spi_6")}
    SELECT event_id, round(spi_6, 4) AS spi_6 FROM i""",
)
def spi_events(spark, sf_dir):
    df, series = event_series(spark, sf_dir, "value")
    df = indices.spi(df, series, "value", 6, "spi_6")
    return df.select("event_id", F.round("spi_6", 4).alias("spi_6"))


@query(
    "sequence_events",
    """WITH w AS (SELECT user_id, ts, event_id, list(value) OVER (PARTITION BY user_id
      ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS seq FROM events)
    SELECT event_id, seq[1] AS oldest, seq[12] AS newest FROM w WHERE len(seq) = 12""",
)
def sequence_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    df, series = chunked(events, Series.of("user_id", ("ts", "event_id")))
    df = windows.sequence_windows(df, series, ["value"], 12)
    return df.select(
        "event_id", F.col("seq")[0][0].alias("oldest"), F.col("seq")[11][0].alias("newest")
    )
