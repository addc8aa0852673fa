"""How the test tables map onto the telemetry model, in Spark and in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from signalmill.functions.timeparts import DAY, HOUR
from signalmill.operators.grid import make_series, search_space
from signalmill.sources.telemetry import canonicalize

START, END = datetime(2024, 1, 1), datetime(2024, 1, 31)
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def signals(t) -> DataFrame:
    """events, one signal per event type."""
    return canonicalize(t.events, "event_type", "ts", "value")


def user_signals(t) -> DataFrame:
    """events, one signal per user."""
    return canonicalize(t.events, F.concat(F.lit("u"), F.col("user_id").cast("string")), "ts", "value")


def hourly(t, filled: bool = True) -> DataFrame:
    return (search_space if filled else make_series)(signals(t), START, END, HOUR)


def user_daily(t, filled: bool = True) -> DataFrame:
    return (search_space if filled else make_series)(user_signals(t), START, END, DAY)


def tracks(t) -> DataFrame:
    """events, entity = user group, track = event type."""
    entity = F.concat(F.lit("e"), (F.col("user_id") % 5).cast("string"))
    return t.events.select(entity.alias("entity_id"), F.col("event_type").alias("track_id"), "ts", "value")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, minus zero folded into zero.

    A nudge far below the last digit keeps exact halves from rounding either way.
    """
    cols = [
        (F.round(F.col(f.name) + F.lit(nudge(digits)), digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def nudge(digits: int) -> float:
    return 3.7e-3 * 10.0**-digits


def sql_round(body: str, doubles: str, digits: int = 6) -> str:
    """Wrap a query so that the listed columns are rounded the same way."""
    cols = ", ".join(f"round({c} + {nudge(digits)}, {digits}) + 0.0 AS {c}" for c in doubles.split())
    return f"SELECT * REPLACE ({cols}) FROM ({body})"


def sql_greedy(source: str, order: str, reach: int, k: int, idx: str = "idx", rank: str = "pick") -> str:
    """CTE ``pk`` and a final SELECT: best-first picks of ``source`` per signal, more than ``reach`` apart."""
    free = f"len(list_filter(taken, lambda x: abs(x - f.{idx}) <= {reach})) = 0"
    return f""", pk AS (SELECT signal_id, 0 AS n, []::BIGINT[] AS taken FROM {source} GROUP BY signal_id UNION ALL
 SELECT pk.signal_id, n + 1, list_append(taken, (SELECT {idx} FROM {source} f WHERE f.signal_id = pk.signal_id AND {free} ORDER BY {order} LIMIT 1)) FROM pk WHERE n < {k})
SELECT f.*, list_position(taken, f.{idx})::BIGINT AS {rank} FROM pk JOIN {source} f USING (signal_id) WHERE n = {k} AND list_contains(taken, f.{idx})"""


def recursive(body: str) -> str:
    """``body`` with its common tables allowed to refer to themselves."""
    return body.replace("WITH ", "WITH RECURSIVE ", 1)


SIGNALS = "raw AS (SELECT event_type AS signal_id, ts, value FROM events)"
USERS = "raw AS (SELECT 'u' || user_id AS signal_id, ts, value FROM events)"


def sql_grid(raw: str = SIGNALS, unit: str = "HOUR", n: int = 720, agg: str = "avg", fill: bool = True) -> str:
    """Common table expressions ``raw, agg, grid`` (and ``filled``) of the START..END grid."""
    us = {"HOUR": HOUR, "3H": 3 * HOUR, "DAY": DAY}[unit]
    default = "coalesce(a.v, 0)::DOUBLE" if agg == "count" else "a.v"
    ctes = f"""{raw},
agg AS (SELECT signal_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // {us} AS bin_idx, {agg}(value) AS v
        FROM raw WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-31' GROUP BY ALL),
grid AS (SELECT s.signal_id, i.i AS bin_idx, TIMESTAMP '2024-01-01' + to_microseconds(i.i * {us}) AS ts, {default} AS value
         FROM (SELECT DISTINCT signal_id FROM raw) s CROSS JOIN range({n}) i(i)
         LEFT JOIN agg a ON a.signal_id = s.signal_id AND a.bin_idx = i.i)"""
    if not fill:
        return "WITH " + ctes
    return f"""WITH {ctes},
near AS (SELECT *,
   last_value(CASE WHEN value IS NOT NULL THEN bin_idx END IGNORE NULLS) OVER b AS pi,
   last_value(value IGNORE NULLS) OVER b AS pv,
   first_value(CASE WHEN value IS NOT NULL THEN bin_idx END IGNORE NULLS) OVER f AS ni,
   first_value(value IGNORE NULLS) OVER f AS nv
   FROM grid
   WINDOW b AS (PARTITION BY signal_id ORDER BY bin_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          f AS (PARTITION BY signal_id ORDER BY bin_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT signal_id, bin_idx, ts,
   CASE WHEN value IS NOT NULL THEN value WHEN pi IS NULL THEN nv WHEN ni IS NULL THEN pv
        ELSE pv + (nv - pv) * (bin_idx - pi) / (ni - pi)::DOUBLE END AS value FROM near)"""


GRID = sql_grid(fill=False)
FILLED = sql_grid()
USER_GRID = sql_grid(USERS, "DAY", 30, fill=False)
TRACKS = "raw AS (SELECT 'e' || (user_id % 5) || '|' || event_type AS signal_id, ts, value FROM events)"
TRACK_GRID = sql_grid(TRACKS, "3H", 240, fill=False)
TRACK_FILLED = sql_grid(TRACKS, "3H", 240)
USER_FILLED = sql_grid(USERS, "DAY", 30)
