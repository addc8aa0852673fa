"""Sources, grids, statistics, catalog and sequences over the test tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from signalmill.functions.timeparts import DAY, HOUR, floor_div, to_us
from signalmill.operators import catalog as C, grid as G, sequences as W, stats as S
from signalmill.plans.registry import query
from signalmill.plans.samples import (
    END, FILLED, GRID, MEASURES, SIGNALS, START, USER_FILLED, USER_GRID, USERS,
    hourly, rounded, signals, sql_grid, sql_round, user_daily, user_signals,
)
from signalmill.sources import telemetry as A

WIDE = [m.replace("l_", "") for m in MEASURES]
FIRST, LAST = datetime(1995, 1, 1), datetime(2002, 1, 1)


# ---------------------------------------------------------------- sources

@query("a01_canonicalize", "SELECT event_type AS signal_id, ts, value FROM events")
def _(t):
    return signals(t)


UNPIVOT = """SELECT l_returnflag || ':' || m AS signal_id, ts, value FROM (
  UNPIVOT (SELECT l_returnflag, l_shipdate AS ts, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
  ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME m VALUE value)"""


@query("a02_unpivot_wide", f"SELECT signal_id, date_trunc('month', ts)::DATE AS month, count(*) AS n, min(value) AS lo, max(value) AS hi FROM ({UNPIVOT}) GROUP BY ALL")
def _(t):
    long = A.unpivot_wide(t.lineitem, "l_returnflag", "l_shipdate", MEASURES, start=FIRST, end=LAST)
    return long.groupBy("signal_id", F.trunc("ts", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )


@query("a02_unpivot_ids", f"SELECT signal_id, ts, value FROM ({UNPIVOT}) WHERE signal_id IN ('A:l_tax', 'R:l_quantity')")
def _(t):
    return A.unpivot_wide(t.lineitem, "l_returnflag", "l_shipdate", MEASURES, ids=["A:l_tax", "R:l_quantity"])


@query("a03_unpivot_preagg", sql_round(f"SELECT signal_id, date_trunc('day', ts)::TIMESTAMP AS ts, avg(value) AS value FROM ({UNPIVOT}) GROUP BY ALL", "value", 4))
def _(t):
    return rounded(A.unpivot_wide(t.lineitem, "l_returnflag", "l_shipdate", MEASURES, start=FIRST, pre_agg=("avg", DAY)), 4)


@query("a04_slice_signal", "SELECT event_type AS signal_id, ts, value FROM events WHERE event_type IN ('click', 'error') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def _(t):
    return A.slice_signal(signals(t), ["click", "error"], datetime(2024, 1, 5), datetime(2024, 1, 20))


@query("a05_full_series", "SELECT o_orderpriority AS signal_id, o_orderdate AS ts, o_totalprice AS value FROM orders")
def _(t):
    return A.slice_signal(A.canonicalize(t.orders, "o_orderpriority", "o_orderdate", "o_totalprice"))


def _binned(agg: str, sql_agg: str):
    sql = f"SELECT event_type AS signal_id, make_timestamp((epoch_us(ts) // {6 * HOUR}) * {6 * HOUR}) AS ts, {sql_agg}(value) AS value FROM events GROUP BY ALL"

    @query(f"a06_binned_{agg}", sql if agg == "count" else sql_round(sql, "value"))
    def _(t, agg=agg):
        return rounded(A.binned_window(signals(t), 6 * HOUR, agg))


for _agg, _sql in (("avg", "avg"), ("min", "min"), ("max", "max"), ("sum", "sum"), ("count", "count"),
                   ("median", "median"), ("stdev", "stddev_samp"), ("any", "min")):
    _binned(_agg, _sql)


@query("a07_read_dimension", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    return A.read_dimension(t.spark, f"{t.folder}/nation.parquet")


CHECKED = """SELECT * FROM (VALUES {rows}) v("check", ok, message) UNION ALL SELECT 'nulls:' || name, n = 0, n::VARCHAR FROM (
 SELECT * FROM (SELECT {nulls} FROM {table}) UNPIVOT (n FOR name IN ({names}))) UNION ALL SELECT 'rows', count(*) > 0, count(*)::VARCHAR FROM {table}"""


def checked(table: str, required: dict[str, str], rows: list[tuple]) -> str:
    """The report that ``validate_source`` should give: fixed rows, then counts of NULLs and rows."""
    text = ", ".join(f"('{a}', {str(b).lower()}, '{c}')" for a, b, c in [*((f"column:{n}", True, "present") for n in required), *rows])
    nulls = ", ".join(f"count(*) FILTER ({e} IS NULL) AS {n}" for n, e in required.items())
    return CHECKED.format(rows=text, nulls=nulls, names=", ".join(required), table=table)


WIDE_ROWS = [("time:l_shipdate", True, "timestamp_ntz"), *((f"numeric:{m}", True, "double") for m in MEASURES), ("measures", True, f"{len(MEASURES)} measures"), *((f"delimiter:{m}", True, "clear") for m in MEASURES)]


@query("a10_validate_wide", checked("lineitem", {n: n for n in ("l_returnflag", "l_shipdate")}, WIDE_ROWS))
def _(t):
    return A.validate_source(t.lineitem, "wide", "l_returnflag", "l_shipdate", measures=MEASURES)


@query("a10_validate_narrow", checked("events", {"signal_id": "event_type", "ts": "ts", "value": "value"}, [("time:ts", True, "timestamp_ntz"), ("numeric:value", True, "double")]))
def _(t):
    return A.validate_source(signals(t))


# ---------------------------------------------------------------- grids and column operators

@query("g01_make_series", sql_round(GRID + " SELECT * FROM grid", "value"))
def _(t):
    return rounded(hourly(t, filled=False))


@query("g01_make_series_count", sql_grid(agg="count", fill=False) + " SELECT * FROM grid")
def _(t):
    return G.make_series(signals(t), START, END, HOUR, "count")


@query("g02_fill_linear", sql_round(FILLED + " SELECT * FROM filled", "value"))
def _(t):
    return rounded(G.fill_linear(hourly(t, filled=False)))


@query("g03_search_space", sql_round(USER_FILLED + " SELECT * FROM filled", "value"))
def _(t):
    return rounded(user_daily(t))


@query("g04_aligned", sql_round(FILLED + """ SELECT bin_idx, ts, max(value) FILTER (signal_id = 'click') AS click,
  max(value) FILTER (signal_id = 'view') AS "view", max(value) FILTER (signal_id = 'error') AS error FROM filled GROUP BY ALL""", 'click "view" error'))
def _(t):
    return rounded(G.aligned(signals(t), ["click", "view", "error"], START, END, HOUR))


@query("p22_analysis_grid", sql_round(FILLED + " SELECT * FROM filled WHERE signal_id = 'click'", "value"))
def _(t):
    return rounded(G.analysis_grid(signals(t), "click", START, END, HOUR))


@query("b10_shift_tz", "SELECT event_type AS signal_id, ts - INTERVAL 330 MINUTE AS ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-30'")
def _(t):
    return A.shift_tz(signals(t), -330, datetime(2024, 1, 2), datetime(2024, 1, 30))


@query("b11_derive", sql_round(FILLED + """, w AS (SELECT bin_idx, ts, max(value) FILTER (signal_id = 'click') AS c,
  max(value) FILTER (signal_id = 'view') AS v FROM filled GROUP BY ALL)
SELECT *, sqrt(abs(c - v)) + 2 * ln(c + 1) / (v + 0.5) - power(v, 0.5) AS value FROM w""", "c v value"))
def _(t):
    return rounded(G.derive(hourly(t), "sqrt(abs(c - v)) + 2 * ln(c + 1) / (v + 0.5) - v ^ 0.5", {"c": "click", "v": "view"}))


@query("b12_rate_of_change", sql_round(GRID + " SELECT *, value - lag(value) OVER (PARTITION BY signal_id ORDER BY bin_idx) AS rate FROM grid", "value rate"))
def _(t):
    return rounded(G.rate_of_change(hourly(t, filled=False)))


@query("b13_rolling_mean", sql_round(GRID + " SELECT *, avg(value) OVER (PARTITION BY signal_id ORDER BY bin_idx ROWS 5 PRECEDING) AS rolling_mean FROM grid", "value rolling_mean"))
def _(t):
    return rounded(G.rolling_mean(hourly(t, filled=False), 6))


ADJUST = [
    {"kind": "scale", "value": 1.5},
    {"kind": "offset", "value": 100.0, "enabled": False},
    {"kind": "offset", "value": -20.0},
    {"kind": "ramp", "ramp_to": 30.0},
    {"kind": "clamp", "min": 0.0, "max": 150.0},
]
SCENARIO = ", scen AS (SELECT *, least(150.0, greatest(0.0, value * 1.5 - 20 + 30.0 * bin_idx / 719)) AS scenario FROM filled)"


@query("b14_adjustments", sql_round(FILLED + SCENARIO + " SELECT * FROM scen", "value scenario"))
def _(t):
    return rounded(G.apply_adjustments(hourly(t), ADJUST))


@query("w09_lag_value", sql_round(FILLED + " SELECT *, lag(value, 24) OVER (PARTITION BY signal_id ORDER BY bin_idx) AS lagged FROM filled", "value lagged"))
def _(t):
    return rounded(G.lag_value(hourly(t), 24))


@query("g26_moving_mean_std", sql_round(FILLED + """ SELECT * EXCLUDE (n) FROM (SELECT *, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS std, count(*) OVER w AS n FROM filled
  WINDOW w AS (PARTITION BY signal_id ORDER BY bin_idx ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)) WHERE n = 24""", "value mean std"))
def _(t):
    return rounded(G.moving_mean_std(hourly(t), 24))


# ---------------------------------------------------------------- statistics

NOW = datetime(2024, 1, 31)
COVER = """SELECT signal_id, true AS has_data, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS count, min(value) AS min, max(value) AS max, avg(value) AS avg,
  CASE WHEN count(*) > 1 THEN (epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE / (count(*) - 1) / 1e6 END AS cadence_s,
  least(100.0, (epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE / (30 * 86400e6) * 100) AS coverage_pct,
  (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts)))::DOUBLE / 60e6 AS age_min,
  (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts)))::DOUBLE / 60e6 > 1440 AS stale
  FROM raw GROUP BY signal_id"""


@query("g05_coverage", sql_round(f"WITH {USERS} {COVER}", "avg cadence_s coverage_pct age_min", 5))
def _(t):
    return rounded(S.coverage(user_signals(t), START, END, NOW, stale_minutes=1440), 5)


@query("g06_coverage_wide", sql_round(f"SELECT signal_id, min(ts) AS first_ts, max(ts) AS last_ts, count(value) AS count, min(value) AS min, max(value) AS max, avg(value) AS avg FROM ({UNPIVOT}) GROUP BY ALL", "avg", 4))
def _(t):
    return rounded(S.coverage_wide(t.lineitem, "l_returnflag", "l_shipdate", MEASURES, FIRST, LAST), 4)


@query("g07_density", sql_round(f"WITH {USERS} SELECT max(n) AS max_count, 2592000 / max(n)::DOUBLE AS native_s, 43200.0::DOUBLE AS projected_points, 43200 > max(n) * 1.5 AS over_resolved FROM (SELECT count(*) AS n FROM raw GROUP BY signal_id)", "native_s"))
def _(t):
    return rounded(S.density(user_signals(t), START, END, 60_000_000))


OHLC = f"bars AS (SELECT signal_id, make_timestamp((epoch_us(ts) // {DAY}) * {DAY}) AS ts, arg_min(value, raw.ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, raw.ts) AS close, count(*) AS volume FROM raw GROUP BY 1, 2)"


@query("g08_ohlc", f"WITH {USERS}, {OHLC} SELECT * FROM bars")
def _(t):
    return S.ohlc(user_signals(t), DAY, START, END)


@query("g09_ohlc_ma", sql_round(f"WITH {USERS}, {OHLC} SELECT *, row_number() OVER s - 1 AS bar, CASE WHEN count(*) OVER w = 5 THEN avg(close) OVER w END AS ma FROM bars WINDOW s AS (PARTITION BY signal_id ORDER BY ts), w AS (PARTITION BY signal_id ORDER BY ts ROWS 4 PRECEDING)", "ma"))
def _(t):
    return rounded(S.ohlc_ma(S.ohlc(user_signals(t), DAY, START, END), 5))


PROFILE = """, steps AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY signal_id ORDER BY bin_idx)) AS step FROM filled),
prof AS (SELECT signal_id, count(value) AS count, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS stdev,
  coalesce(max(step), 0) AS max_abs_step, coalesce(max(step), 0) / 60.0 AS max_rate_per_min FROM steps GROUP BY signal_id)"""


@query("g10_signal_profile", sql_round(FILLED + PROFILE + " SELECT * FROM prof", "min max mean stdev max_abs_step max_rate_per_min"))
def _(t):
    return rounded(S.signal_profile(signals(t), START, END, HOUR))


@query("g28_suggest_envelope", sql_round(FILLED + PROFILE + """ SELECT signal_id, mean - 3 * stdev AS lower_operating_limit, mean AS operating_setpoint,
  mean + 3 * stdev AS upper_operating_limit, min AS physical_min, max AS physical_max, max_rate_per_min AS max_rate_of_change FROM prof""",
  "lower_operating_limit operating_setpoint upper_operating_limit physical_min physical_max max_rate_of_change"))
def _(t):
    return rounded(S.suggest_envelope(S.signal_profile(signals(t), START, END, HOUR)))


STATS = """count(value) AS count, min(value) AS min, max(value) AS max, avg(value) AS mean,
  CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) END AS stdev,
  quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.95) AS p95"""


@query("g11_describe", sql_round(USER_GRID + f" SELECT signal_id, {STATS} FROM grid GROUP BY signal_id", "min max mean stdev median p05 p95"))
def _(t):
    return rounded(S.describe_signals(user_daily(t, filled=False)))


@query("g11_describe_raw", sql_round(f"WITH {SIGNALS} SELECT signal_id, {STATS} FROM raw GROUP BY signal_id", "min max mean stdev median p05 p95"))
def _(t):
    return rounded(S.describe_signals(signals(t)))


@query("g12_histogram", sql_round(FILLED + """, e AS (SELECT signal_id, min(value) AS a, max(value) AS z FROM filled GROUP BY signal_id),
c AS (SELECT signal_id, least(29, floor((value - a) / ((z - a) / 30)))::INT AS bin, count(*) AS n FROM filled JOIN e USING (signal_id) GROUP BY ALL)
SELECT e.signal_id, b.b::INT AS bin, a + b.b * ((z - a) / 30) AS lo, a + (b.b + 1) * ((z - a) / 30) AS hi, coalesce(n, 0) AS count
FROM e CROSS JOIN range(30) b(b) LEFT JOIN c ON c.signal_id = e.signal_id AND c.bin = b.b""", "lo hi"))
def _(t):
    return rounded(S.histogram(hourly(t)))


BOX = """, q AS (SELECT signal_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM filled GROUP BY signal_id)"""


@query("g13_box_summary", sql_round(FILLED + BOX + """ SELECT signal_id, q1, median, q3, min(value) AS min, max(value) AS max,
  min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
  FROM filled JOIN q USING (signal_id) GROUP BY ALL""", "q1 median q3 min max whisker_low whisker_high"))
def _(t):
    return rounded(S.box_summary(hourly(t)))


@query("g13_box_outliers", sql_round(FILLED + BOX + " SELECT filled.* FROM filled JOIN q USING (signal_id) WHERE NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)", "value"))
def _(t):
    return rounded(S.box_outliers(hourly(t)))


@query("g14_duration_curve", sql_round(f"""WITH {SIGNALS}, r AS (SELECT signal_id, value, row_number() OVER (PARTITION BY signal_id ORDER BY value DESC) AS i, count(*) OVER (PARTITION BY signal_id) AS n FROM raw)
SELECT signal_id, i::DOUBLE / n * 100 AS percent, value FROM r""", "percent"))
def _(t):
    return rounded(S.duration_curve(signals(t)))


@query("g14_duration_curve_thinned", sql_round(f"""WITH {SIGNALS}, r AS (SELECT signal_id, value, row_number() OVER (PARTITION BY signal_id ORDER BY value DESC) - 1 AS i, count(*) OVER (PARTITION BY signal_id) AS n FROM raw),
s AS (SELECT *, CASE WHEN n > 500 THEN ceil(n / 500)::BIGINT ELSE 1 END AS step FROM r)
SELECT signal_id, CASE WHEN i % step = 0 THEN (i + 1)::DOUBLE / n * 100 ELSE 100.0 END AS percent, value FROM s WHERE i % step = 0 OR i = n - 1""", "percent"))
def _(t):
    return rounded(S.duration_curve(signals(t), 500))


@query("g15_attr_heatmap", sql_round(GRID + " SELECT signal_id, hour(ts)::INT AS x, (isodow(ts) - 1)::INT AS y, avg(value) AS value FROM grid WHERE value IS NOT NULL GROUP BY ALL", "value"))
def _(t):
    return rounded(S.attr_heatmap(hourly(t, filled=False), "hour", "dayOfWeek"))


@query("s26_time_attr", "SELECT event_id, minute(ts)::INT AS minute, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS dow, (day(ts) - 1)::INT AS dom, (month(ts) - 1)::INT AS month FROM (SELECT event_id, ts + INTERVAL 120 MINUTE AS ts FROM events)")
def _(t):
    from signalmill.functions.timeparts import shift, time_attr

    at = shift("ts", 120)
    parts = {"minute": "minute", "hour": "hour", "dow": "dayOfWeek", "dom": "dayOfMonth", "month": "month"}
    return t.events.select("event_id", *[time_attr(at, a).alias(n) for n, a in parts.items()])


HALVES = [("first", START, datetime(2024, 1, 16)), ("second", datetime(2024, 1, 16), END)]


def _half(label: str, start: str, end: str, n: int) -> str:
    body = sql_grid(n=n).replace("2024-01-31", end).replace("2024-01-01", start)
    return f"({body} SELECT '{label}' AS period, * FROM filled)"


@query("g16_compare_periods", sql_round(f"""WITH halves AS ({_half('first', '2024-01-01', '2024-01-16', 360)} UNION ALL {_half('second', '2024-01-16', '2024-01-31', 360)}),
st AS (SELECT period, signal_id, {STATS}, regr_slope(value, bin_idx) AS slope FROM halves GROUP BY ALL)
SELECT st.*, CASE WHEN slope > (st.max - st.min) * 1e-3 THEN 'rising' WHEN slope < -(st.max - st.min) * 1e-3 THEN 'falling' ELSE 'flat' END AS trend,
 mean - r.m AS delta, (mean - r.m) / abs(r.m) * 100 AS delta_pct
FROM st JOIN (SELECT signal_id, mean AS m FROM st WHERE period = 'first') r USING (signal_id)""", "min max mean stdev median p05 p95 slope delta delta_pct"))
def _(t):
    return rounded(S.compare_periods(signals(t), HALVES, HOUR))


@query("g16_rebase", """SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'first' ELSE 'second' END AS period, event_type AS signal_id,
 epoch_us(ts) - epoch_us(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-16' END) AS offset_us, value FROM events""")
def _(t):
    return S.rebase(signals(t), HALVES)


@query("g17_kpis", sql_round(FILLED + " SELECT signal_id, avg(value) AS mean, min(value) AS min, max(value) AS max, sum(value) * 3600 AS integral, count(*) FILTER (value >= 60) * 3600.0::DOUBLE AS time_above_limit FROM filled GROUP BY signal_id", "mean min max integral", 4))
def _(t):
    return rounded(S.kpis(hourly(t), HOUR, 60.0), 4)


@query("g18_risk_flags", FILLED + SCENARIO + """, k AS (SELECT signal_id, avg(value) AS bm, min(value) AS bn, avg(scenario) AS m, min(scenario) AS n, max(scenario) AS x FROM scen GROUP BY signal_id),
f AS (SELECT signal_id, 'critical' AS severity, 'above_upper_limit' AS flag FROM k WHERE x > 140
 UNION ALL SELECT signal_id, 'warning', 'below_lower_limit' FROM k WHERE n < 5
 UNION ALL SELECT signal_id, 'warning', 'new_negatives' FROM k WHERE n < 0 AND bn >= 0
 UNION ALL SELECT signal_id, 'info', 'mean_shift' FROM k WHERE bm <> 0 AND abs((m - bm) / abs(bm)) >= 0.5)
SELECT * FROM f UNION ALL SELECT signal_id, 'info', 'none' FROM k WHERE signal_id NOT IN (SELECT signal_id FROM f)""")
def _(t):
    return S.risk_flags(G.apply_adjustments(hourly(t), ADJUST), upper=140.0, lower=5.0)


@query("g19_overview", sql_round(FILLED + " " + " UNION ALL ".join(
    f"SELECT signal_id, {k} AS level, bin_idx // {8 * 4 ** k} AS bucket, min(value) AS t_min, max(value) AS t_max, avg(value) AS t_avg, bin_idx // {8 * 4 ** k} * {8 * 4 ** k} AS start_idx FROM filled GROUP BY ALL"
    for k in range(3)), "t_min t_max t_avg"))
def _(t):
    return rounded(S.overview(hourly(t)))


@query("g20_downsample_minmax", sql_round(FILLED + """, b AS (SELECT *, ((bin_idx + 1) * 50 - 1) // 720 AS bk FROM filled),
p AS (SELECT signal_id, arg_min(bin_idx, (value, bin_idx)) AS a, arg_min(bin_idx, (-value, bin_idx)) AS z FROM b GROUP BY signal_id, bk)
SELECT * FROM filled f WHERE bin_idx IN (0, 719) OR EXISTS (SELECT 1 FROM p WHERE p.signal_id = f.signal_id AND f.bin_idx IN (p.a, p.z))""", "value"))
def _(t):
    return rounded(S.downsample_minmax(hourly(t), 50))


@query("g21_paa_downsample", sql_round(FILLED + """ SELECT signal_id, ((bin_idx + 1) * 100 - 1) // 720 AS bucket, make_timestamp(floor(avg(epoch_us(ts)))::BIGINT) AS ts, avg(value) AS value FROM filled GROUP BY 1, 2""", "value"))
def _(t):
    return rounded(S.paa_downsample(hourly(t), 100))


@query("g22_robust_normalize", sql_round(FILLED + """, q AS (SELECT signal_id, quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS z FROM filled GROUP BY signal_id)
SELECT filled.*, least(1, greatest(0, (value - a) / (z - a))) AS unit FROM filled JOIN q USING (signal_id)""", "value unit"))
def _(t):
    return rounded(S.robust_normalize(hourly(t)))


@query("g23_change_feature", sql_round(GRID + """ SELECT *, abs(value - avg(value) OVER (PARTITION BY signal_id)) AS deviation,
 CASE WHEN value IS NOT NULL THEN coalesce(abs(value - lag(value) OVER (PARTITION BY signal_id ORDER BY bin_idx)), 0) END AS change FROM grid""", "value deviation change"))
def _(t):
    return rounded(S.change_feature(hourly(t, filled=False)))


@query("g24_trend_label", sql_round(USER_GRID + """ SELECT signal_id, slope, CASE WHEN slope > eps THEN 'rising' WHEN slope < -eps THEN 'falling' ELSE 'flat' END AS trend
FROM (SELECT signal_id, coalesce(regr_slope(value, bin_idx), 0) AS slope, CASE WHEN max(value) > min(value) THEN (max(value) - min(value)) * 1e-3 ELSE 1e-9 END AS eps FROM grid GROUP BY signal_id)""", "slope"))
def _(t):
    return rounded(S.trend_label(user_daily(t, filled=False)))


@query("g27_calendar_heatmap", sql_round(USER_GRID + " SELECT * FROM grid", "value"))
def _(t):
    return rounded(S.calendar_heatmap(user_signals(t), START, END))


# ---------------------------------------------------------------- catalog

def hierarchy(t):
    """Suppliers as signals under region / nation."""
    return (
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_name").alias("signal_id"), F.col("r_name").alias("level1"), F.col("n_name").alias("level2"))
    )


def metadata(t):
    """Part facts of the part that shares the supplier's key, as tag metadata."""
    return t.supplier.join(t.part, F.col("s_suppkey") == F.col("p_partkey")).select(
        F.col("s_name").alias("signal_id"),
        F.col("p_name").alias("signal_name"),
        F.col("p_brand").alias("metric"),
        F.col("p_type").alias("description"),
        (F.col("s_acctbal") + 100).alias("usl"),
        F.when(F.col("p_size") > 20, F.col("s_acctbal") - 100).alias("lsl"),
        F.when(F.col("p_size") < 40, F.col("s_acctbal") + 50).alias("upper_operating_limit"),
        F.col("p_retailprice").alias("physical_max"),
    )


def cat(t):
    return C.catalog(hierarchy(t), metadata(t))


CAT = """WITH cat AS (SELECT s_name AS signal_id, coalesce(p_name, NULL) AS signal_name, p_brand AS metric, p_type AS description, r_name AS level1, n_name AS level2,
  s_acctbal + 100 AS usl, CASE WHEN p_size > 20 THEN s_acctbal - 100 END AS lsl, CASE WHEN p_size < 40 THEN s_acctbal + 50 END AS upper_operating_limit, p_retailprice AS physical_max
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON s_suppkey = p_partkey)"""
SHOWN = ["signal_id", "signal_name", "metric", "description", "level1", "level2", "usl", "lsl", "upper_operating_limit", "physical_max"]


@query("b01_catalog", sql_round(CAT + " SELECT *, '' AS unit, '' AS level3, NULL::DOUBLE AS target FROM cat", "usl lsl upper_operating_limit"))
def _(t):
    return rounded(cat(t).select(*SHOWN, "unit", "level3", "target"))


@query("b02_search", sql_round(CAT + " SELECT * FROM cat WHERE (signal_name || signal_id || metric || description) ILIKE '%widget%' AND (lower(signal_name) LIKE '%1%' OR lower(signal_id) LIKE '%1%' OR lower(metric) LIKE '%1%' OR lower(description) LIKE '%1%')", "usl lsl upper_operating_limit"))
def _(t):
    return rounded(C.search(cat(t), "WIDGET 1").select(*SHOWN))


@query("b03_filter_catalog", sql_round(CAT + " SELECT * FROM cat WHERE level1 = 'ASIA' AND description IN ('ECONOMY', 'PROMO', 'STANDARD') AND metric IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#11', 'Brand#12', 'Brand#13')", "usl lsl upper_operating_limit"))
def _(t):
    brands = [f"Brand#{i}" for i in (1, 2, 3, 11, 12, 13)]
    out = C.filter_catalog(cat(t), {"level1": "ASIA"}, {"description": ["ECONOMY", "PROMO", "STANDARD"], "metric": brands})
    return rounded(out.select(*SHOWN))


@query("b04_page", CAT + " SELECT signal_id, signal_name FROM cat ORDER BY signal_name, signal_id LIMIT 21 OFFSET 40")
def _(t):
    return C.page(cat(t), 40, 20).select("signal_id", "signal_name")


@query("b05_count_tags", CAT + " SELECT count(*) AS count FROM cat WHERE level1 = 'EUROPE'")
def _(t):
    return C.count_tags(C.filter_catalog(cat(t), {"level1": "EUROPE"}))


@query("b06_children", CAT + " SELECT level2 AS value, count(*) AS count FROM cat WHERE level1 = 'AFRICA' GROUP BY level2")
def _(t):
    return C.children(cat(t), "level2", {"level1": "AFRICA"})


@query("b07_facet_values", CAT + " SELECT metric AS value, count(*) AS count FROM cat WHERE metric ILIKE '%#1%' AND metric <> '' GROUP BY metric")
def _(t):
    return C.facet_values(cat(t), "metric", "#1")


def governed(t):
    """Order rows as versions of governed limits for the supplier that shares the customer key."""
    return t.orders.join(t.supplier, F.col("o_custkey") == F.col("s_suppkey")).select(
        F.col("s_name").alias("signal_id"),
        F.col("o_orderpriority").alias("scope_key"),
        F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "draft").otherwise("retired").alias("status"),
        F.col("o_orderkey").alias("version"),
        F.col("o_totalprice").alias("usl"),
        F.when(F.col("o_totalprice") > 150000, F.col("o_totalprice") / 2).alias("lsl"),
    )


GOV = """gov AS (SELECT s_name AS signal_id, o_orderpriority AS scope_key, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'draft' ELSE 'retired' END AS status,
  o_orderkey AS version, o_totalprice AS usl, CASE WHEN o_totalprice > 150000 THEN o_totalprice / 2 END AS lsl FROM orders JOIN supplier ON o_custkey = s_suppkey),
eff AS (SELECT * FROM gov WHERE status <> 'retired' QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY version DESC) = 1)"""


@query("b09_effective_metadata", f"WITH {GOV} SELECT * FROM eff")
def _(t):
    return C.effective_metadata(governed(t))


@query("b09_effective_approved", f"WITH {GOV} SELECT * FROM gov WHERE status <> 'retired' QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY status = 'approved' DESC, version DESC) = 1")
def _(t):
    return C.effective_metadata(governed(t), prefer_approved=True)


@query("b08_overlay", sql_round(CAT + f", {GOV} SELECT cat.* REPLACE (coalesce(eff.usl, cat.usl) AS usl, coalesce(eff.lsl, cat.lsl) AS lsl) FROM cat LEFT JOIN eff USING (signal_id)", "usl lsl upper_operating_limit"))
def _(t):
    return rounded(C.overlay_metadata(cat(t), C.effective_metadata(governed(t))).select(*SHOWN))


@query("b15_limit_defaults", sql_round(CAT + """ SELECT signal_id, coalesce(usl, upper_operating_limit, lsl) AS threshold,
 CASE WHEN coalesce(usl, upper_operating_limit) IS NOT NULL THEN 'above' WHEN lsl IS NOT NULL THEN 'below' END AS direction,
 coalesce(upper_operating_limit, usl) AS upper_limit, lsl AS lower_limit, NULL::DOUBLE AS plausible_min, physical_max AS plausible_max,
 NULL::DOUBLE AS rate_per_minute, NULL::DOUBLE AS confidence FROM cat""", "threshold upper_limit lower_limit"))
def _(t):
    return rounded(C.limit_defaults(cat(t)))


def saved_patterns(t):
    """Events as saved pattern spans."""
    return t.events.select(
        F.col("event_id").alias("label_id"),
        F.concat(F.lit("pattern "), F.col("event_id").cast("string")).alias("name"),
        F.when(F.col("value") > 100, "discord").otherwise("motif").alias("kind"),
        F.get_json_object("props", "$.k").alias("category"),
        F.col("event_type").alias("signal_id"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("signal_name"),
        F.when(F.col("value") < 20, "chains").otherwise("matrix_profile").alias("analysis_type"),
        F.lit("").alias("job_id"),
        F.col("ts").alias("created_at"),
    )


PATTERNS = """WITH pat AS (SELECT event_id AS label_id, 'pattern ' || event_id AS name, CASE WHEN value > 100 THEN 'discord' ELSE 'motif' END AS kind,
 json_extract_string(props, '$.k') AS category, event_type AS signal_id, 'user ' || user_id AS signal_name,
 CASE WHEN value < 20 THEN 'chains' ELSE 'matrix_profile' END AS analysis_type, '' AS job_id, ts AS created_at FROM events)"""


@query("b16_filter_labels", PATTERNS + " SELECT * FROM pat WHERE kind = 'discord' AND lower(name || ' ' || category || ' ' || signal_id || ' ' || signal_name || ' ') LIKE '%user 1%'")
def _(t):
    return C.sort_labels(C.filter_labels(saved_patterns(t), kind="discord", text="USER 1"))


@query("b16_label_facets", PATTERNS + " SELECT DISTINCT 'category' AS facet, category AS value FROM pat UNION SELECT 'signal_id', signal_id FROM pat UNION SELECT 'analysis_type', analysis_type FROM pat")
def _(t):
    return C.label_facets(saved_patterns(t))


# ---------------------------------------------------------------- windows and sequences

@query("w01_rank_within", "SELECT event_type AS signal_id, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rank FROM events")
def _(t):
    return W.rank_within(signals(t), ["signal_id"], ["ts"], floor_div(to_us("ts"), DAY))


STATE = "CASE WHEN value >= 80 THEN 'high' WHEN value >= 30 THEN 'normal' ELSE 'low' END"


@query("w02_dedup_runs", sql_round(FILLED + f", s AS (SELECT *, {STATE} AS word FROM filled) SELECT * FROM s QUALIFY lag(word) OVER (PARTITION BY signal_id ORDER BY bin_idx) IS DISTINCT FROM word", "value"))
def _(t):
    grid = hourly(t).withColumn("word", W.band_column(F.col("value"), [30.0, 80.0], ["low", "normal", "high"]))
    return rounded(W.dedup_runs(grid, ["signal_id"], "word"))


@query("w03_longest_gap", USER_GRID + """, f AS (SELECT *, sum(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY signal_id ORDER BY bin_idx) AS g FROM grid),
c AS (SELECT signal_id, g, count(*) FILTER (value IS NULL) AS n FROM f GROUP BY ALL) SELECT signal_id, max(n) AS max_missing_run FROM c GROUP BY signal_id""")
def _(t):
    return W.longest_gap(user_daily(t, filled=False))


EPISODES = f""", s AS (SELECT *, {STATE} AS state FROM filled),
c AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY signal_id ORDER BY bin_idx) IS DISTINCT FROM state THEN 1 ELSE 0 END AS n FROM s),
e AS (SELECT *, sum(n) OVER (PARTITION BY signal_id ORDER BY bin_idx) - 1 AS seg FROM c),
ep AS (SELECT signal_id, seg::BIGINT AS seg_id, state, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS bins FROM e GROUP BY ALL)"""


def episodes(t):
    return W.state_episodes(hourly(t), [30.0, 80.0], ["low", "normal", "high"])


@query("w04_state_episodes", FILLED + EPISODES + " SELECT * FROM ep")
def _(t):
    return episodes(t)


@query("w05_state_dwell", FILLED + EPISODES + " SELECT signal_id, state, count(*) AS episodes, sum(bins * 3600.0)::DOUBLE AS total_s FROM ep GROUP BY ALL")
def _(t):
    return W.state_dwell(episodes(t), HOUR)


@query("w06_mine_sequences", FILLED + EPISODES + """, g AS (SELECT signal_id, state || ' > ' || lead(state) OVER o || ' > ' || lead(state, 2) OVER o AS sequence,
 (bins + lead(bins) OVER o + lead(bins, 2) OVER o) * 3600.0::DOUBLE AS d FROM ep WINDOW o AS (PARTITION BY signal_id ORDER BY seg_id))
SELECT signal_id, sequence, count(*) AS count, quantile_cont(d, 0.5)::DOUBLE AS median_s FROM g WHERE sequence IS NOT NULL GROUP BY ALL""")
def _(t):
    return W.mine_sequences(episodes(t), 3, HOUR)
