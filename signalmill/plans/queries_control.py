"""Control charts, capability and forecasts over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalmill.functions.normal import normal_cdf, normal_quantile
from signalmill.functions.timeparts import DAY, HOUR, floor_div, to_us
from signalmill.operators import forecast as P, spc as S
from signalmill.operators.grid import make_series
from signalmill.plans.queries_relate import DECOMP
from signalmill.plans.registry import query
from signalmill.plans.runtime import checkpointed
from signalmill.plans.samples import END, FILLED, START, hourly, rounded, signals, sql_grid, sql_round

# ---------------------------------------------------------------- control charts


def part_readings(t):
    """Line items as readings of the supplier's process."""
    return t.lineitem.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("signal_id"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("value"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
    )


ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def groups(t, n=5):
    # day-stamped readings: a quarter of one supplier is a short, bounded bucket
    return S.subgroups(part_readings(t), n, order=ORDER, bucket=floor_div(to_us("ts"), 90 * DAY))


def _sub(n: int) -> str:
    keep = "" if n == 1 else " HAVING count(*) >= 2"
    return f"""sub AS (SELECT signal_id, pos // {n} AS subgroup, max(ts) AS ts, count(*) AS n, avg(value) AS mean, max(value) - min(value) AS range, coalesce(stddev_samp(value), 0) AS stdev
 FROM (SELECT 's' || l_suppkey AS signal_id, l_shipdate AS ts, l_quantity AS value, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pos FROM lineitem) GROUP BY ALL{keep})"""


@query("c01_subgroups", sql_round(f"WITH {_sub(5)} SELECT * FROM sub", "mean range stdev"))
def _(t):
    return rounded(groups(t))


def _points(chart: str) -> str:
    n = 1 if chart == "i-mr" else 5
    var = {"i-mr": "abs(mean - lag(mean) OVER (PARTITION BY signal_id ORDER BY subgroup))", "xbar-r": "range", "xbar-s": "stdev"}[chart]
    return f"WITH {_sub(n)}, pts AS (SELECT signal_id, subgroup, ts, mean AS value, {var} AS variation, n FROM sub)"


def _limits(chart: str) -> str:
    k = {"i-mr": "1 / 1.128", "xbar-r": "0.577 / 3", "xbar-s": "1.427 / 3"}[chart]
    lo, hi = {"i-mr": (0, 3.267), "xbar-r": (0, 2.114), "xbar-s": (0, 2.089)}[chart]
    size = 1 if chart == "i-mr" else 5
    return _points(chart) + f""", av AS (SELECT signal_id, count(*) AS n_subgroups, avg(value) AS center, avg(variation) AS s_center FROM pts GROUP BY signal_id),
lim AS (SELECT signal_id, '{chart}' AS chart, {size}::BIGINT AS subgroup_size, n_subgroups, center, s_center * {k} AS sigma, center + 3 * s_center * {k} AS ucl, center - 3 * s_center * {k} AS lcl, s_center, s_center * {hi} AS s_ucl, s_center * {lo} AS s_lcl FROM av)"""


LIM = "center sigma ucl lcl s_center s_ucl s_lcl"
for _chart, _n in (("i-mr", 1), ("xbar-r", 5), ("xbar-s", 5)):

    @query(f"c02_limits_{_chart.replace('-', '_')}", sql_round(_limits(_chart) + " SELECT * FROM lim", LIM))
    def _(t, chart=_chart, n=_n):
        return rounded(S.control_limits(groups(t, n), chart))

    @query(f"c03_points_{_chart.replace('-', '_')}", sql_round(_points(_chart) + " SELECT * FROM pts", "value variation"))
    def _(t, chart=_chart, n=_n):
        return rounded(S.chart_points(groups(t, n), chart))


CHART = _limits("xbar-r") + """, cc AS (SELECT pts.*, center, sigma, ucl, lcl, s_center, s_ucl, s_lcl, 'I' AS phase, (value - center) / sigma AS zone FROM pts JOIN lim USING (signal_id))"""


@query("c04_control_chart", sql_round(CHART + " SELECT * FROM cc", "value variation zone " + LIM))
def _(t):
    return rounded(S.control_chart(groups(t), "xbar-r"))


@query("c04_phase_two", sql_round(CHART + """, base AS (SELECT 's' || s_suppkey AS signal_id, 25.0 + s_suppkey % 3 AS center, 6.0 AS sigma FROM supplier)
SELECT pts.*, base.center::DOUBLE AS center, base.sigma::DOUBLE AS sigma, base.center + 18.0::DOUBLE AS ucl, base.center - 18.0::DOUBLE AS lcl, 30.0::DOUBLE AS s_center, 63.0::DOUBLE AS s_ucl, 0.0::DOUBLE AS s_lcl, 'II' AS phase, (value - base.center) / 6.0::DOUBLE AS zone FROM pts JOIN base USING (signal_id)""", "value variation zone " + LIM))
def _(t):
    c = (F.lit(25.0) + F.col("s_suppkey") % 3).cast("double")
    frozen = t.supplier.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("signal_id"),
        c.alias("center"), F.lit(6.0).alias("sigma"), (c + 18.0).alias("ucl"), (c - 18.0).alias("lcl"),
        F.lit(30.0).alias("s_center"), F.lit(63.0).alias("s_ucl"), F.lit(0.0).alias("s_lcl"),
    )
    return rounded(S.control_chart(groups(t), "xbar-r", frozen))


def _rules_sql(profile: str, same_side: int) -> str:
    on = S.PROFILES[profile][0]
    span = lambda k: f"(PARTITION BY signal_id ORDER BY subgroup ROWS {k - 1} PRECEDING)"
    cnt = lambda cond, k: f"count(*) FILTER ({cond}) OVER {span(k)}"
    rules = {
        1: "CASE WHEN value > ucl THEN 'above' WHEN value < lcl THEN 'below' END",
        2: f"CASE WHEN {cnt('value > center', same_side)} = {same_side} THEN 'above' WHEN {cnt('value < center', same_side)} = {same_side} THEN 'below' END",
        3: f"CASE WHEN {cnt('d > 0', 5)} = 5 THEN 'above' WHEN {cnt('d < 0', 5)} = 5 THEN 'below' END",
        4: f"CASE WHEN {cnt('alt', 12)} = 12 THEN 'both' END",
        5: f"CASE WHEN subgroup < 2 THEN NULL WHEN z >= 2 AND {cnt('z >= 2', 3)} >= 2 THEN 'above' WHEN z <= -2 AND {cnt('z <= -2', 3)} >= 2 THEN 'below' END",
        6: f"CASE WHEN subgroup < 4 THEN NULL WHEN z >= 1 AND {cnt('z >= 1', 5)} >= 4 THEN 'above' WHEN z <= -1 AND {cnt('z <= -1', 5)} >= 4 THEN 'below' END",
        7: f"CASE WHEN {cnt('abs(z) < 1', 15)} = 15 THEN 'both' END",
        8: f"CASE WHEN {cnt('abs(z) > 1', 8)} = 8 THEN 'both' END",
    }
    picks = " UNION ALL ".join(f"SELECT signal_id, subgroup, ts, value, {r} AS rule_id, {rules[r]} AS side FROM da" for r in on)
    return CHART + f""", dd AS (SELECT *, zone AS z, sign(value - lag(value) OVER (PARTITION BY signal_id ORDER BY subgroup)) AS d FROM cc),
da AS (SELECT *, d <> 0 AND d = -lag(d) OVER (PARTITION BY signal_id ORDER BY subgroup) AS alt FROM dd),
vi AS (SELECT * FROM ({picks}) WHERE side IS NOT NULL)"""


@query("c05_rules_nelson", sql_round(_rules_sql("nelson", 9) + " SELECT * FROM vi", "value"))
def _(t):
    return rounded(S.run_rules(S.control_chart(groups(t), "xbar-r"), "nelson"))


@query("c05_rules_weco", sql_round(_rules_sql("weco", 8) + " SELECT * FROM vi", "value"))
def _(t):
    return rounded(S.run_rules(S.control_chart(groups(t), "xbar-r"), "weco"))


@query("c05_rules_basic", sql_round(_rules_sql("basic", 9) + " SELECT * FROM vi", "value"))
def _(t):
    return rounded(S.run_rules(S.control_chart(groups(t), "xbar-r"), "basic"))


CDF = "(CASE WHEN {x} >= 0 THEN 1 - {t} ELSE {t} END)"


def _cdf(x: str) -> str:
    k = f"(1 / (1 + 0.2316419 * abs({x})))"
    tail = f"(0.3989422804014327 * exp(-({x}) * ({x}) / 2) * {k} * (0.31938153 + {k} * (-0.356563782 + {k} * (1.781477937 + {k} * (-1.821255978 + {k} * 1.330274429)))))"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


@query("c06_capability", sql_round(f"""WITH r AS (SELECT 's' || l_suppkey AS signal_id, l_quantity::DOUBLE AS value FROM lineitem),
a AS (SELECT signal_id, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sigma, count(*) FILTER (value < 5 OR value > 46) AS o FROM r GROUP BY signal_id)
SELECT signal_id, n, mean, sigma, 41 / 72.0::DOUBLE AS cp, (46 - mean) / 36 AS cpu, (mean - 5) / 36 AS cpl, least((46 - mean) / 36, (mean - 5) / 36) AS cpk,
 41 / (6 * sigma) AS pp, (46 - mean) / (3 * sigma) AS ppu, (mean - 5) / (3 * sigma) AS ppl, least((46 - mean) / (3 * sigma), (mean - 5) / (3 * sigma)) AS ppk, 41 / (6 * sqrt(sigma * sigma + (mean - 25) * (mean - 25))) AS cpm,
 {_cdf('((5 - mean) / sigma)')} * 1e6 AS ppm_below, (1 - {_cdf('((46 - mean) / sigma)')}) * 1e6 AS ppm_above,
 {_cdf('((5 - mean) / sigma)')} * 1e6 + (1 - {_cdf('((46 - mean) / sigma)')}) * 1e6 AS ppm_total, {_cdf('((5 - mean) / 12)')} * 1e6 + (1 - {_cdf('((46 - mean) / 12)')}) * 1e6 AS ppm_potential,
 o / n::DOUBLE * 1e6 AS ppm_observed, true AS allowed, '' AS warnings FROM a""", "mean sigma cp cpu cpl cpk pp ppu ppl ppk cpm ppm_below ppm_above ppm_total ppm_potential ppm_observed", 4))
def _(t):
    specs = t.supplier.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("signal_id"),
        F.lit(5.0).alias("lsl"), F.lit(46.0).alias("usl"), F.lit(25.0).alias("target"), F.lit(12.0).alias("sigma_w"), F.lit(True).alias("in_control"),
    )
    return rounded(S.capability(part_readings(t), specs), 4)


@query("c07_sufficiency", f"WITH {_sub(25)} SELECT signal_id, count(*) AS subgroups, count(*) >= 20 AS sufficient, CASE WHEN count(*) >= 25 THEN 'good' WHEN count(*) >= 20 THEN 'thin' ELSE 'insufficient' END AS grade FROM sub GROUP BY signal_id")
def _(t):
    return S.baseline_sufficiency(groups(t, 25))


@query("c08_observed_run_length", sql_round(_rules_sql("nelson", 9) + """, fs AS (SELECT signal_id, min(subgroup) + 1 AS f FROM vi GROUP BY signal_id), ln AS (SELECT signal_id, max(subgroup) + 1 AS l FROM cc GROUP BY signal_id)
SELECT count(*) AS series, count(f) AS signalled, avg(coalesce(f, l)) AS mean_run_length, 1 / avg(coalesce(f, l)) AS alpha FROM ln LEFT JOIN fs USING (signal_id)""", "mean_run_length alpha"))
def _(t):
    return rounded(S.observed_run_length(S.control_chart(groups(t), "xbar-r"), "nelson"))


@query("c09_baseline_versions", sql_round(_limits("xbar-r") + """, ev AS (SELECT signal_id AS baseline_id, 1 AS version, 'draft' AS status, 1 AS seq, center FROM lim UNION ALL
 SELECT signal_id, 1, 'approved', 2, center FROM lim UNION ALL SELECT signal_id, 2, 'draft', 1, center + 1 FROM lim UNION ALL
 SELECT signal_id, 2, 'approved', 2, center + 1 FROM lim WHERE center >= 25)
SELECT baseline_id, version, center FROM ev WHERE status = 'approved' QUALIFY row_number() OVER (PARTITION BY baseline_id ORDER BY version DESC) = 1""", "center"))
def _(t):
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    limits = S.control_limits(groups(t), "xbar-r")
    log = S.save_baseline(limits, F.col("signal_id"), "ops", at)
    log = S.approve(log, log, "lead", at)
    log = S.revise(log, limits.withColumn("center", F.col("center") + 1).withColumn("baseline_id", F.col("signal_id")), "ops", at)
    drafts = log.filter((F.col("version") == 2) & (F.col("center") >= 26))
    log = S.approve(log, drafts, "lead", at)
    return rounded(S.effective_baselines(log).select("baseline_id", "version", "center"))


@query("s25_normal", sql_round(f"SELECT event_id, {_cdf('((value - 50) / 40)')} AS p FROM events", "p", 8))
def _(t):
    return rounded(t.events.select("event_id", normal_cdf((F.col("value") - 50) / 40).alias("p")), 8)


# ---------------------------------------------------------------- forecasts
H, P24 = 48, 24
FC = """, ft AS (SELECT signal_id, regr_slope(value, bin_idx) AS s, regr_intercept(value, bin_idx) AS c FROM filled GROUP BY signal_id),
se AS (SELECT signal_id, bin_idx % 24 AS ph, avg(value - (c + s * bin_idx)) AS raw FROM filled JOIN ft USING (signal_id) GROUP BY ALL),
sn AS (SELECT signal_id, ph, raw - avg(raw) OVER (PARTITION BY signal_id) AS sea FROM se),
al AS (SELECT signal_id, i AS bin_idx, TIMESTAMP '2024-01-01' + to_hours(i::INT) AS ts, CASE WHEN i >= 720 THEN (i - 719)::INT END AS step FROM ft CROSS JOIN range(768) r(i)),
fb AS (SELECT al.*, f.value, c + s * al.bin_idx + sea AS forecast FROM al JOIN ft USING (signal_id) JOIN sn ON sn.signal_id = al.signal_id AND sn.ph = al.bin_idx % 24 LEFT JOIN filled f ON f.signal_id = al.signal_id AND f.bin_idx = al.bin_idx),
fc AS (SELECT *, value - forecast AS residual, stddev_samp(value - forecast) OVER (PARTITION BY signal_id) AS sigma FROM fb)"""


def fc(t):
    return P.forecast(hourly(t), H, HOUR, P24)


@query("f01_forecast", sql_round(FILLED + FC + " SELECT * FROM fc", "value forecast residual sigma"))
def _(t):
    return rounded(fc(t))


CLEAN = DECOMP + """, cq AS (SELECT signal_id, quantile_cont(value, 0.1) AS qa, quantile_cont(value, 0.9) AS qz FROM filled GROUP BY signal_id),
cl AS (SELECT signal_id, bin_idx, ts, value, CASE WHEN value > qz THEN (value - qz) / (qz - qa) WHEN value < qa THEN (value - qa) / (qz - qa) ELSE 0 END AS score, baseline FROM dec JOIN cq USING (signal_id))"""


@query("f02_clean_outliers", sql_round(FILLED + CLEAN + " SELECT * EXCLUDE (baseline), CASE WHEN abs(score) < 0.4 THEN value ELSE baseline END AS model_value FROM cl", "value score model_value"))
def _(t):
    return rounded(P.clean_outliers(hourly(t), 0.4, P24))


BANDS = FC + """, rq AS (SELECT signal_id, quantile_cont(residual, 0.025) AS ql, quantile_cont(residual, 0.975) AS qh FROM fc WHERE step IS NULL GROUP BY signal_id),
an AS (SELECT signal_id, arg_max(value, bin_idx) AS av FROM fc WHERE value IS NOT NULL GROUP BY signal_id),
bd AS (SELECT signal_id, bin_idx, ts, value, step, residual, sigma, CASE WHEN bin_idx = 719 THEN av WHEN step IS NOT NULL THEN forecast END AS forecast,
 CASE WHEN bin_idx = 719 THEN av ELSE forecast + ql * sqrt(step) END AS lower, CASE WHEN bin_idx = 719 THEN av ELSE forecast + qh * sqrt(step) END AS upper, 'empirical' AS method, false AS imputed
 FROM fc JOIN rq USING (signal_id) JOIN an USING (signal_id))"""
BAND_COLS = "value forecast residual sigma lower upper"


@query("f03_forecast_bands", sql_round(FILLED + BANDS + " SELECT * FROM bd", BAND_COLS))
def _(t):
    return rounded(P.forecast_bands(fc(t), 0.95))


@query("f03_forecast_coverage", sql_round(sql_grid(agg="count", fill=False) + """, g AS (SELECT *, sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY signal_id ORDER BY bin_idx) AS k FROM grid),
r AS (SELECT signal_id, k, count(*) FILTER (value = 0) AS n FROM g GROUP BY ALL)
SELECT signal_id, count(*) AS history_bins, count(*) FILTER (value = 0) AS missing_bins, 719 - max(bin_idx) FILTER (value > 0) AS trailing_stale_bins, count(*) FILTER (value = 0) / count(*)::DOUBLE AS missing_fraction,
 (SELECT max(n) FROM r WHERE r.signal_id = grid.signal_id) AS longest_gap_bins FROM grid GROUP BY signal_id""", "missing_fraction"))
def _(t):
    return rounded(P.forecast_coverage(make_series(signals(t), START, END, HOUR, "count")))


PLAN = P.plan_backtest(720, H)


def _backtest_sql(name: str, fit: int) -> str:
    return f""", {name}_o AS (SELECT o FROM range({PLAN.history}, {720 - H + 1}, {PLAN.step}) r(o)),
{name}_f AS (SELECT signal_id, o, regr_slope(value, bin_idx) AS s, regr_intercept(value, bin_idx) AS c FROM filled JOIN {name}_o ON bin_idx >= o - {fit} AND bin_idx < o GROUP BY ALL),
{name}_r AS (SELECT signal_id, o, bin_idx % 24 AS ph, avg(value - (c + s * bin_idx)) AS raw FROM filled JOIN {name}_f USING (signal_id) WHERE bin_idx >= o - {fit} AND bin_idx < o GROUP BY ALL),
{name}_s AS (SELECT *, raw - avg(raw) OVER (PARTITION BY signal_id, o) AS sea FROM {name}_r),
{name} AS (SELECT signal_id, o AS origin, (bin_idx - o + 1)::INT AS h, value AS actual, c + s * bin_idx + sea AS forecast, value - (c + s * bin_idx + sea) AS error
 FROM filled JOIN {name}_f USING (signal_id) JOIN {name}_s USING (signal_id, o) WHERE bin_idx >= o AND bin_idx < o + {H} AND ph = bin_idx % 24)"""


def errors(t, fit=None):
    return P.backtest(hourly(t), H, PLAN.history, PLAN.step, P24, fit)


@query("f04_backtest", sql_round(FILLED + _backtest_sql("bt", PLAN.history) + " SELECT * FROM bt", "actual forecast error"))
def _(t):
    return rounded(errors(t))


@query("f05_measured_bands", sql_round(FILLED + BANDS + _backtest_sql("bt", PLAN.history) + """, eq AS (SELECT signal_id, h AS step, quantile_cont(error, 0.025) AS el, quantile_cont(error, 0.975) AS eh FROM bt GROUP BY ALL)
SELECT bd.* REPLACE (coalesce(forecast + el, lower) AS lower, coalesce(forecast + eh, upper) AS upper, CASE WHEN el IS NOT NULL THEN 'backtest' ELSE method END AS method)
 FROM bd LEFT JOIN eq ON eq.signal_id = bd.signal_id AND eq.step = bd.step""", BAND_COLS))
def _(t):
    grid = checkpointed(hourly(t))  # read by the forecast and by the backtest
    bands = P.forecast_bands(P.forecast(grid, H, HOUR, P24), 0.95)
    return rounded(P.measured_bands(bands, P.backtest(grid, H, PLAN.history, PLAN.step, P24), 0.95))


RECENT = P.recent_window(PLAN.history, H)


@query("f06_select_model", sql_round(FILLED + _backtest_sql("bt", PLAN.history) + _backtest_sql("br", RECENT) + """, a AS (SELECT signal_id, sqrt(avg(error * error)) AS base_rmse FROM bt GROUP BY signal_id), b AS (SELECT signal_id, sqrt(avg(error * error)) AS candidate_rmse FROM br GROUP BY signal_id)
SELECT signal_id, base_rmse, candidate_rmse, CASE WHEN candidate_rmse < base_rmse * 0.98 THEN 'candidate' ELSE 'base' END AS choice FROM a JOIN b USING (signal_id)""", "base_rmse candidate_rmse"))
def _(t):
    grid = checkpointed(hourly(t))
    full, recent = (P.backtest(grid, H, PLAN.history, PLAN.step, P24, w) for w in (None, RECENT))
    return rounded(P.select_model(full, recent))


@query("f07_quantile_curves", sql_round(FILLED + FC + """, q AS (SELECT signal_id, 0.1::DOUBLE AS p, quantile_cont(residual, 0.1) AS r FROM fc WHERE step IS NULL GROUP BY ALL UNION ALL SELECT signal_id, 0.5::DOUBLE, quantile_cont(residual, 0.5) FROM fc WHERE step IS NULL GROUP BY ALL
 UNION ALL SELECT signal_id, 0.9::DOUBLE, quantile_cont(residual, 0.9) FROM fc WHERE step IS NULL GROUP BY ALL)
SELECT signal_id, bin_idx, ts, step, p, forecast + r * sqrt(step) AS value FROM fc JOIN q USING (signal_id) WHERE step IS NOT NULL""", "value"))
def _(t):
    return rounded(P.quantile_curves(fc(t), [0.1, 0.5, 0.9]))


@query("f08_exceedance_steps", sql_round(FILLED + FC + """ SELECT f.signal_id, f.step, avg((f.forecast + r.residual * sqrt(f.step) > 120)::INT) AS probability FROM fc f JOIN fc r ON f.signal_id = r.signal_id AND f.step IS NOT NULL AND r.step IS NULL GROUP BY ALL""", "probability"))
def _(t):
    return rounded(P.exceedance_steps(fc(t), 120.0))


@query("f08_exceedance", sql_round(FILLED + FC + """, sp AS (SELECT f.signal_id, f.step, avg((f.forecast + r.residual * sqrt(f.step) > 200)::INT) AS probability FROM fc f JOIN fc r ON f.signal_id = r.signal_id AND f.step IS NOT NULL AND r.step IS NULL GROUP BY ALL),
sf AS (SELECT signal_id, max(probability) AS peak_probability, arg_max(step, (probability, -step)) AS peak_step, min(step) FILTER (probability >= 0.5) AS first_likely_step FROM sp GROUP BY ALL),
ps AS (SELECT signal_id, residual, row_number() OVER w - 1 AS nth, sum(residual) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM fc WHERE step IS NULL AND residual IS NOT NULL WINDOW w AS (PARTITION BY signal_id ORDER BY bin_idx)),
pt AS (SELECT a.signal_id, a.nth, count(*) AS c, max(f.forecast + b.run - (a.run - a.residual)) > 200 AS hit FROM ps a JOIN fc f ON f.signal_id = a.signal_id AND f.step IS NOT NULL JOIN ps b ON b.signal_id = a.signal_id AND b.nth = a.nth + f.step - 1 GROUP BY ALL),
sh AS (SELECT signal_id, avg(hit::INT) AS any_breach_probability FROM pt WHERE c = (SELECT max(step) FROM fc) GROUP BY ALL)
SELECT sf.*, any_breach_probability, 'trajectory' AS method FROM sf JOIN sh USING (signal_id)""", "peak_probability any_breach_probability"))
def _(t):
    return rounded(P.exceedance(fc(t), 200.0))


@query("f09_forecast_features", sql_round(FILLED + BANDS + """, fu AS (SELECT * FROM bd WHERE step IS NOT NULL),
fe AS (SELECT signal_id, regr_slope(forecast, step) AS slope, arg_min(forecast, step) AS first_forecast, arg_max(forecast, step) AS last_forecast, avg(forecast) AS mean_forecast, min(forecast) AS min_forecast,
 arg_min(ts, (forecast, step)) AS min_ts, max(forecast) AS max_forecast, arg_min(ts, (-forecast, step)) AS max_ts, max(sigma) AS sigma, arg_min(upper - forecast, step) AS half_width_first, arg_max(upper - forecast, step) AS half_width_last FROM fu GROUP BY signal_id)
SELECT *, last_forecast - first_forecast AS total_change, (last_forecast - first_forecast) / abs(first_forecast) AS pct_change,
 CASE WHEN abs(slope) <= sigma * 0.01 THEN 'flat' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS direction, half_width_last / half_width_first AS widening_ratio FROM fe""",
 "slope first_forecast last_forecast mean_forecast min_forecast max_forecast sigma half_width_first half_width_last total_change pct_change widening_ratio"))
def _(t):
    return rounded(P.forecast_features(P.forecast_bands(fc(t), 0.95)))
