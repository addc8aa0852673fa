"""Multivariate detectors over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalmill.functions.timeparts import DAY, HOUR
from signalmill.operators import multivariate as M
from signalmill.plans.registry import query
from signalmill.plans.samples import END, START, TRACK_FILLED, TRACK_GRID, rounded, sql_round, tracks

BIN = 3 * HOUR
SPLIT = "split_part(signal_id, '|', 1) AS entity_id, split_part(signal_id, '|', 2) AS track_id"


def prep(t, min_coverage=0.05, max_gap=200):
    return M.prepare(tracks(t), START, END, BIN, min_coverage, max_gap)


def flat(df):
    """Result rows without nested columns: the contributors as text."""
    names = F.array_join(F.transform("contributors", lambda c: c["track_id"]), ",")
    return df.withColumn("contributors", names).drop("explain")


QUALITY = """, gp AS (SELECT *, sum(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY signal_id ORDER BY bin_idx) AS k FROM grid),
gr AS (SELECT signal_id, k, count(*) FILTER (value IS NULL) AS m FROM gp GROUP BY ALL),
tk AS (SELECT signal_id, count(*) AS point_count, count(value) AS observed_bins, count(value) / count(*)::DOUBLE AS coverage, (SELECT max(m) FROM gr WHERE gr.signal_id = grid.signal_id) AS max_missing_run FROM grid GROUP BY signal_id),
tq AS (SELECT *, CASE WHEN observed_bins = 0 THEN 'no_finite_observations' WHEN coverage < 0.8 THEN 'insufficient_coverage' WHEN max_missing_run > 3 THEN 'max_gap_exceeded' ELSE '' END AS validation_error FROM tk)"""


@query("d00_prepare", sql_round(TRACK_GRID + QUALITY + f" SELECT {SPLIT}, TIMESTAMP '2024-01-01' AS series_start, TIMESTAMP '2024-01-31' AS series_end, 10800000000::BIGINT AS bin_us, point_count, observed_bins, coverage, max_missing_run, validation_error = '' AS is_valid, validation_error FROM tq", "coverage"))
def _(t):
    return rounded(prep(t, 0.8, 3).tracks)


@query("d00_prepared_grid", sql_round(TRACK_FILLED + f" SELECT {SPLIT}, bin_idx, ts, value FROM filled", "value"))
def _(t):
    return rounded(prep(t).grid)


@query("d07_coverage_report", sql_round(TRACK_GRID + QUALITY + f" SELECT {SPLIT}, point_count, observed_bins, coverage, max_missing_run, validation_error = '' AS is_valid, validation_error FROM tq", "coverage"))
def _(t):
    return rounded(M.coverage_report(prep(t, 0.8, 3)))


@query("d15_coverage_rollup", sql_round(TRACK_GRID + QUALITY + " SELECT split_part(signal_id, '|', 1) AS entity_id, count(*) AS track_count, min(coverage) AS min_coverage, max(max_missing_run) AS worst_max_gap, count(*) FILTER (validation_error <> '') AS invalid_tracks FROM tq GROUP BY 1", "min_coverage"))
def _(t):
    return rounded(M.coverage_rollup(M.coverage_report(prep(t, 0.8, 3))))


@query("d01_profile", TRACK_GRID + QUALITY + f""", pr AS (SELECT *, {SPLIT} FROM tq)
SELECT entity_id, TIMESTAMP '2024-01-01' AS series_start, TIMESTAMP '2024-01-31' AS series_end, 10800000000::BIGINT AS bin_us, 240::BIGINT AS point_count, 8::BIGINT AS detection_bins, count(*) AS track_count,
 count(*) FILTER (validation_error = '') AS valid_track_count, count(*) FILTER (validation_error <> '') AS invalid_track_count,
 CASE WHEN bool_or(validation_error IN ('insufficient_coverage', 'max_gap_exceeded')) THEN 'insufficient_coverage' WHEN bool_or(validation_error <> '') THEN 'invalid_input' ELSE 'ok' END AS status,
 coalesce(string_agg(DISTINCT validation_error, ',' ORDER BY validation_error) FILTER (validation_error <> ''), '') AS detail FROM pr GROUP BY entity_id""")
def _(t):
    return M.profile(prep(t, 0.8, 3).tracks, DAY, 16)


RESIDUAL = """, ds AS (SELECT *, value - coalesce(lag(value, 8) OVER (PARTITION BY signal_id ORDER BY bin_idx), 0) AS d FROM filled),
rs AS (SELECT *, d - (2 * coalesce(sum(d) OVER (PARTITION BY signal_id ORDER BY bin_idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0) / 8 - coalesce(sum(d) OVER (PARTITION BY signal_id ORDER BY bin_idx ROWS BETWEEN 16 PRECEDING AND 9 PRECEDING), 0) / 8) AS residual FROM ds),
hs AS (SELECT signal_id, avg(residual) AS m, stddev_pop(residual) AS sd FROM rs WHERE bin_idx < 232 GROUP BY signal_id),
sd AS (SELECT rs.signal_id, bin_idx, ts, value, d, residual, CASE WHEN sd >= 1e-6 THEN (residual - m) / sd ELSE residual - m END AS st FROM rs JOIN hs USING (signal_id))"""


@query("s20_causal_deseason", sql_round(TRACK_FILLED + RESIDUAL + f" SELECT {SPLIT}, bin_idx, ts, value, d AS deseasoned FROM ds", "value deseasoned"))
def _(t):
    return rounded(M.causal_deseason(prep(t).grid, 8))


@query("s21_causal_residual", sql_round(TRACK_FILLED + RESIDUAL + f" SELECT {SPLIT}, bin_idx, ts, value, residual FROM rs", "value residual"))
def _(t):
    return rounded(M.causal_residual(prep(t).grid, 8))


@query("s22_standardize_history", sql_round(TRACK_FILLED + RESIDUAL + f" SELECT {SPLIT}, bin_idx, ts, value, residual, st AS standardized FROM sd", "value residual standardized"))
def _(t):
    return rounded(M.standardize_history(M.causal_residual(prep(t).grid, 8), "residual", 232))


@query("s23_fir", sql_round(TRACK_FILLED + f" SELECT {SPLIT}, bin_idx, ts, value, value - 0.5 * coalesce(lag(value) OVER w, 0) + 0.25 * coalesce(lag(value, 3) OVER w, 0) AS filtered FROM filled WINDOW w AS (PARTITION BY signal_id ORDER BY bin_idx)", "value filtered"))
def _(t):
    return rounded(M.fir(prep(t).grid, [1.0, -0.5, 0.0, 0.25]))


@query("s24_hann", sql_round(TRACK_FILLED + f" SELECT {SPLIT}, bin_idx, value * (0.5 - 0.5 * cos(2 * pi() * bin_idx / 239)) AS windowed FROM filled", "windowed"))
def _(t):
    grid = prep(t).grid
    return rounded(grid.select("entity_id", "track_id", "bin_idx", (F.col("value") * M.hann(F.col("bin_idx"), 240)).alias("windowed")))


def _vote_sql(src: str, feature: str, thr: float, rms: float, votes: str, extreme: float, voices: str, algorithm: str, first: str, keep: str) -> str:
    """Pooling of an evidence table (entity_id, track_id, bin_idx, feature) into flat result rows."""
    return f""", vt AS (SELECT entity_id, bin_idx, sqrt(sum({feature} * {feature}) / {voices}) AS score, max({feature}) AS mx, count(*) FILTER ({feature} >= {thr}) AS vote_count FROM {src} GROUP BY ALL),
vr AS (SELECT *, score >= {rms} OR vote_count >= {votes} OR mx >= {extreme} AS is_anomaly, greatest(score / {rms}, vote_count / {votes}::DOUBLE, mx / {extreme}) AS severity FROM vt),
vk AS (SELECT * FROM vr WHERE {keep})
SELECT vk.entity_id, '{algorithm}' AS algorithm, bin_idx AS event_index, TIMESTAMP '2024-01-01' + to_hours((bin_idx * 3)::INT) AS event_time, TIMESTAMP '2024-01-01' + to_hours((({first}) * 3)::INT) AS window_start,
 TIMESTAMP '2024-01-01' + to_hours(((bin_idx + 1) * 3)::INT) AS window_end, score, {rms}::DOUBLE AS threshold, severity, is_anomaly, vote_count, vote_count / {voices}::DOUBLE AS vote_fraction, 5::BIGINT AS track_count, coalesce(cs, '') AS contributors, 'ok' AS status
 FROM vk LEFT JOIN top USING (entity_id, bin_idx)"""


def _top_sql(src: str, feature: str, k: int, where: str = "true") -> str:
    return f""", top AS (SELECT entity_id, bin_idx, string_agg(track_id, ',' ORDER BY {feature} DESC, track_id) AS cs FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, bin_idx ORDER BY {feature} DESC, track_id) AS rk FROM {src} WHERE {where}) WHERE rk <= {k} GROUP BY ALL)"""


FENCE = "CASE WHEN {v} > qz THEN ({v} - qz) / (qz - qa) WHEN {v} < qa THEN ({v} - qa) / (qz - qa) ELSE 0 END"
VOTING = RESIDUAL + f""", oq AS (SELECT signal_id, quantile_cont(st, 0.1) AS qa, quantile_cont(st, 0.9) AS qz FROM sd GROUP BY signal_id),
ev AS (SELECT {SPLIT}, bin_idx, abs({FENCE.format(v='st')}) AS f FROM sd JOIN oq USING (signal_id) WHERE bin_idx >= 232)""" + _top_sql("ev", "f", 5)
NUMBERS = "score threshold severity vote_fraction"
SETTINGS = dict(feature_threshold=0.5, rms_threshold=0.4, min_votes=2, min_fraction=0.3, extreme_threshold=1.0)


@query("d02_residual_voting", sql_round(TRACK_FILLED + VOTING + _vote_sql("ev", "f", 0.5, 0.4, "2", 1.0, "5", "residual_voting", "bin_idx", "true"), NUMBERS))
def _(t):
    return rounded(flat(M.residual_voting(prep(t), DAY, 8, emit_all=True, **SETTINGS)))


CONTRAST = f""", ds AS (SELECT *, value - coalesce(lag(value, 8) OVER (PARTITION BY signal_id ORDER BY bin_idx), 0) AS d FROM filled),
dd AS (SELECT *, d - coalesce(lag(d) OVER (PARTITION BY signal_id ORDER BY bin_idx), 0) AS s FROM ds),
lc AS (SELECT *, sum(d) OVER a / 6 - coalesce(sum(d) OVER b, 0) / 6 AS lv, sum(s) OVER a / 6 - coalesce(sum(s) OVER b, 0) / 6 AS sl FROM dd
 WINDOW a AS (PARTITION BY signal_id ORDER BY bin_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), b AS (PARTITION BY signal_id ORDER BY bin_idx ROWS BETWEEN 11 PRECEDING AND 6 PRECEDING)),
cq AS (SELECT signal_id, quantile_cont(CASE WHEN bin_idx >= 11 THEN lv END, 0.1) AS la, quantile_cont(CASE WHEN bin_idx >= 11 THEN lv END, 0.9) AS lz, quantile_cont(CASE WHEN bin_idx >= 12 THEN sl END, 0.1) AS sa, quantile_cont(CASE WHEN bin_idx >= 12 THEN sl END, 0.9) AS sz FROM lc GROUP BY signal_id),
cs AS (SELECT *, abs({FENCE.format(v='lv').replace('qz', 'lz').replace('qa', 'la')}) AS ls, abs({FENCE.format(v='sl').replace('qz', 'sz').replace('qa', 'sa')}) AS ss FROM lc JOIN cq USING (signal_id) WHERE bin_idx >= 232),
ev AS (SELECT {SPLIT}, bin_idx, sqrt((ls * ls + ss * ss) / 2) AS f FROM cs)""" + _top_sql("ev", "f", 5)


@query("d03_change_point", sql_round(TRACK_FILLED + CONTRAST + _vote_sql("ev", "f", 0.3, 0.25, "2", 0.8, "5", "change_point", "bin_idx - 11", "is_anomaly"), NUMBERS))
def _(t):
    out = M.change_point(prep(t), DAY, 8, contrast=6, track_threshold=0.3, rms_threshold=0.25, min_votes=2, min_fraction=0.3, extreme_threshold=0.8)
    return rounded(flat(out))


PROJECTION = RESIDUAL + f""", tr AS (SELECT DISTINCT signal_id, {SPLIT} FROM sd),
pj AS (SELECT tr.*, p, sha256('signalmill|' || p || '|' || track_id) AS h, sha256('signalmill|force|' || p || '|' || track_id) AS fh FROM tr CROSS JOIN range(16) r(p)),
pk AS (SELECT *, ('0x' || substr(h, 1, 2))::INT / 256.0 < 0.25 OR row_number() OVER (PARTITION BY entity_id, p ORDER BY fh) = 1 AS inc, CASE WHEN ('0x' || substr(h, 3, 1))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END AS sg FROM pj),
wt AS (SELECT *, sg / sqrt(count(*) OVER (PARTITION BY entity_id, p)) AS w FROM pk WHERE inc),
py AS (SELECT entity_id, p, bin_idx, sum(w * st) AS y FROM wt JOIN sd USING (signal_id) GROUP BY ALL),
pq AS (SELECT entity_id, p, quantile_cont(y, 0.1) AS qa, quantile_cont(y, 0.9) AS qz FROM py GROUP BY ALL),
ev AS (SELECT entity_id, p, bin_idx, abs({FENCE.format(v='y')}) AS f FROM py JOIN pq USING (entity_id, p) WHERE bin_idx >= 232),
sh AS (SELECT wt.entity_id, wt.track_id, p, bin_idx, round(abs(w * st), 9) AS f FROM wt JOIN sd USING (signal_id) WHERE bin_idx >= 232),
top AS (SELECT entity_id, bin_idx, string_agg(track_id, ',' ORDER BY f DESC, track_id, p) AS cs FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, bin_idx ORDER BY f DESC, track_id, p) AS rk FROM sh) WHERE rk <= 8 GROUP BY ALL)"""


@query("d04_random_projection", sql_round(TRACK_FILLED + PROJECTION + _vote_sql("ev", "f", 0.2, 0.3, "4", 0.7, "16", "random_projection", "bin_idx", "is_anomaly"), NUMBERS))
def _(t):
    out = M.random_projection(
        prep(t), DAY, 8, count=16, density=0.25, seed="signalmill", projection_threshold=0.2, rms_threshold=0.3, min_votes=4, extreme_threshold=0.7
    )
    return rounded(flat(out))


@query("d04_projection_weights", sql_round(TRACK_FILLED + PROJECTION + " SELECT entity_id, track_id, p::INT AS projection_id, w AS weight FROM wt", "weight"))
def _(t):
    return rounded(M.projection_weights(prep(t).tracks, 16, 0.25, "signalmill"))


@query("d04_work_guard", TRACK_FILLED + PROJECTION + """ SELECT entity_id, -1::BIGINT AS event_index, 'work_limit_exceeded' AS status, count(*) * 240 > 1000 AS over_limit FROM wt GROUP BY entity_id""")
def _(t):
    out = M.random_projection(prep(t), DAY, 8, count=16, max_work_rows=1000)
    return out.select("entity_id", "event_index", "status", (F.regexp_extract(F.col("explain")["detail"], r"(\d+)", 1).cast("bigint") > 1000).alias("over_limit"))


@query("d05_spectral")
def _(t):
    out = M.spectral(prep(t), 4 * DAY, 6, 4, track_threshold=0.5, rms_threshold=0.5, extreme_threshold=2.0, emit_all=True)
    return rounded(flat(out))


@query("d14_contributor_shares", sql_round(TRACK_FILLED + VOTING + """, vt AS (SELECT entity_id, bin_idx, sqrt(sum(f * f) / 5) AS score, max(f) AS mx, count(*) FILTER (f >= 0.5) AS vc FROM ev GROUP BY ALL),
an AS (SELECT entity_id, bin_idx, vc FROM vt WHERE score >= 0.4 OR vc >= 2 OR mx >= 1.0),
rk AS (SELECT ev.*, vc, f >= 0.5 AS voted, (row_number() OVER (PARTITION BY entity_id, bin_idx ORDER BY f DESC, track_id))::INT AS rank FROM ev JOIN an USING (entity_id, bin_idx)),
sw AS (SELECT * FROM rk WHERE CASE WHEN vc > 0 THEN voted AND rank <= 5 ELSE rank = 1 END)
SELECT entity_id, 'residual_voting' AS algorithm, bin_idx AS event_index, rank, track_id, f AS score, voted, f / sum(f) OVER (PARTITION BY entity_id, bin_idx) AS share FROM sw""", "score share"))
def _(t):
    return rounded(M.contributor_shares(M.residual_voting(prep(t), DAY, 8, **SETTINGS)))
