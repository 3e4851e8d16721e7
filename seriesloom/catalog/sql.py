"""Pieces of SQL that several queries share (DuckDB dialect)."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions import special

ORDERS = """
orders_by_nation AS (
  SELECT o.*, c_mktsegment, n_name AS entity
  FROM orders o JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey)"""

PANEL = ORDERS + """,
lines AS (
  SELECT entity, o_orderdate, l_shipdate, l_quantity,
         least(4, ceil(l_quantity / 12.5::DOUBLE)) AS band,
         round(l_extendedprice * 100)::BIGINT AS cents,
         round(l_discount * 100)::BIGINT AS discount,
         round(o_totalprice * 100)::BIGINT AS total
  FROM lineitem JOIN orders_by_nation ON l_orderkey = o_orderkey),
by_order AS (
  SELECT entity, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month,
         sum(l_quantity) AS wet, """ + ", ".join(
    f"sum(cents) FILTER (band = {i})::DOUBLE / 100::DOUBLE"
    f" / nullif(count(*) FILTER (band = {i}), 0)::DOUBLE AS m{i}"
    for i in (1, 2, 3, 4)
) + """,
         sum(discount)::DOUBLE / 100::DOUBLE / count(*)::DOUBLE AS g,
         sum(total)::DOUBLE / 100::DOUBLE / count(*)::DOUBLE AS t
  FROM lines GROUP BY ALL),
by_ship AS (
  SELECT entity, year(l_shipdate)::INT AS year, month(l_shipdate)::INT AS month,
         sum(l_quantity) AS dry
  FROM lines GROUP BY ALL),
panel AS (
  SELECT entity, year, month, make_date(year, month, 1) AS date,
         wet, dry, m1, m2, m3, m4, g, t
  FROM by_order FULL JOIN by_ship USING (entity, year, month))"""

PREDICTIONS = ORDERS + """,
predictions AS (
  SELECT o_orderkey, entity, o_orderdate::DATE AS date, o_orderstatus AS true_label,
         CASE WHEN o_totalprice < 170000 THEN 'F' WHEN o_totalprice < 340000 THEN 'O'
              ELSE 'P' END AS lstm_pred,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'F'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'O' ELSE 'P' END AS rf_pred,
         CASE WHEN day(o_orderdate) <= 10 THEN 'F' WHEN day(o_orderdate) <= 20 THEN 'O'
              ELSE 'P' END AS xgb_pred
  FROM orders_by_nation)"""


def title_case(text: str) -> str:
    """Strip and title-case, missing as ``Nan``; ``text`` is a column name."""
    return f"""coalesce(array_to_string(list_transform(
        range(1, length({text}) + 1),
        lambda i: CASE WHEN i > 1 AND upper({text}[i - 1]) <> lower({text}[i - 1])
                       THEN lower({text}[i]) ELSE upper({text}[i]) END), ''), 'Nan')"""


def interpolation(source: str, target: str, entity: str, order: str, columns: Sequence[str]) -> str:
    """CTEs that fill the gaps of ``columns``; other columns pass through."""
    found, filled = [], []
    for c in columns:
        for side, fn, frame in (
            ("p", "last_value", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"),
            ("n", "first_value", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"),
        ):
            over = f"OVER (PARTITION BY {entity} ORDER BY {order} {frame})"
            found.append(f"{fn}({c} IGNORE NULLS) {over} AS {side}v_{c}")
            found.append(
                f"{fn}(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) {over} AS {side}p_{c}"
            )
        filled.append(
            f"coalesce({c}, pv_{c} + (nv_{c} - pv_{c}) / nullif(np_{c} - pp_{c}, 0)::DOUBLE"
            f" * (pos - pp_{c}), pv_{c}, nv_{c}) AS {c}"
        )
    return f"""
{target}_pos AS (
  SELECT *, row_number() OVER (PARTITION BY {entity} ORDER BY {order}) AS pos FROM {source}),
{target}_near AS (SELECT *, {", ".join(found)} FROM {target}_pos),
{target} AS (SELECT * REPLACE ({", ".join(filled)}) FROM {target}_near)"""


def _horner(x: str, coefficients: Sequence[float]) -> str:
    highest, *rest = reversed(coefficients)
    text = f"{highest!r}::DOUBLE"
    for c in rest:
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def norm_ppf(p: str) -> str:
    q = f"({p} - 0.5::DOUBLE)"
    r = f"sqrt(-ln(least({p}, 1::DOUBLE - {p})))"
    centre = f"(0.180625::DOUBLE - {q} * {q})"
    central = f"{q} * {_horner(centre, special.CENTRAL_NUM)} / {_horner(centre, special.CENTRAL_DEN)}"
    mid, far = f"({r} - 1.6::DOUBLE)", f"({r} - 5::DOUBLE)"
    middle = f"{_horner(mid, special.MIDDLE_NUM)} / {_horner(mid, special.MIDDLE_DEN)}"
    tail = f"{_horner(far, special.TAIL_NUM)} / {_horner(far, special.TAIL_DEN)}"
    return f"""CASE WHEN {p} IS NULL THEN NULL
      WHEN {p} <= 0 THEN '-inf'::DOUBLE WHEN {p} >= 1 THEN 'inf'::DOUBLE
      WHEN abs({q}) <= 0.425 THEN {central}
      ELSE sign({q}) * CASE WHEN {r} <= 5 THEN {middle} ELSE {tail} END END"""


def _digamma(a: str) -> str:
    y = f"({a} + 12)"
    inv2 = f"(1::DOUBLE / ({y} * {y}))"
    series = f"{inv2} * " + _horner(inv2, [1 / 12, -1 / 120, 1 / 252, -1 / 240])
    down = f"list_sum(list_transform(range(12), lambda k: 1::DOUBLE / ({a} + k)))"
    return f"(ln({y}) - 0.5::DOUBLE / {y} - {series} - {down})"


def _trigamma(a: str) -> str:
    y = f"({a} + 12)"
    inv2 = f"(1::DOUBLE / ({y} * {y}))"
    series = _horner(inv2, [1 / 6, -1 / 30, 1 / 42, -1 / 30])
    down = f"list_sum(list_transform(range(12), lambda k: 1::DOUBLE / (({a} + k) * ({a} + k))))"
    return f"(1::DOUBLE / {y} + 0.5::DOUBLE * {inv2} + {inv2} / {y} * {series} + {down})"


def gamma_fits(source: str, target: str, entity: str, value: str, k: int) -> str:
    """CTEs for one row per entity: n, mean, shape, scale. Ten Newton steps, one CTE each."""
    text = f"""
{target}_0 AS (
  SELECT {entity}, count(x) AS n, avg(x) AS mean,
         CASE WHEN count(x) >= {k} AND ln(avg(x)) - avg(ln(x)) > 1e-12
              THEN ln(avg(x)) - avg(ln(x)) END AS s,
         ((3 - s) + sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s) AS a
  FROM (SELECT {entity}, CASE WHEN {value} > 0 THEN {value} END AS x FROM {source})
  GROUP BY {entity})"""
    for i in range(1, 11):
        text += f""",
{target}_{i} AS MATERIALIZED (
  SELECT {entity}, n, mean, s,
         a - (ln(a) - {_digamma("a")} - s) / (1::DOUBLE / a - {_trigamma("a")}) AS a
  FROM {target}_{i - 1})"""
    return text + f""",
{target} AS (SELECT {entity}, n, mean, a AS shape, mean / a AS scale FROM {target}_10)"""


def gamma_index(
    source: str, target: str, entity: str, order: str, value: str, k: int, output: str
) -> str:
    """CTEs that add the standardised index of the k-row sums of ``value``."""
    over = f"OVER (PARTITION BY {entity} ORDER BY {order} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    cdf = """CASE WHEN x IS NULL OR shape IS NULL THEN NULL WHEN x <= 0 THEN 0::DOUBLE
         WHEN x / scale > shape + 20 * sqrt(shape) + 200 THEN 1::DOUBLE
         ELSE least(1::DOUBLE, list_sum(list_transform(
           range((ceil(greatest(x / scale - shape, 0) + 10 * sqrt(x / scale) + 50))::BIGINT),
           lambda j: exp((shape + j) * ln(x / scale) - x / scale - lgamma(shape + j + 1))))) END"""
    return f"""
{target}_sum AS (
  SELECT *, CASE WHEN count({value}) {over} = {k} THEN sum({value}) {over} END + 0.01::DOUBLE AS x
  FROM {source}),
{gamma_fits(f"{target}_sum", f"{target}_fit", entity, "x", k)},
{target}_p AS MATERIALIZED (
  SELECT s.*, {cdf} AS p FROM {target}_sum s JOIN {target}_fit f
  ON s.{entity} IS NOT DISTINCT FROM f.{entity}),
{target} AS (SELECT * EXCLUDE (x, p), {norm_ppf("p")} AS {output} FROM {target}_p)"""


def rounded(columns: Sequence[str], digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
