"""Matrix-profile analyses over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalmill.functions.timeparts import HOUR
from signalmill.operators import profile as P
from signalmill.operators.grid import search_space
from signalmill.operators.stats import overview
from signalmill.plans.registry import query
from signalmill.plans.runtime import checkpointed
from signalmill.plans.samples import END, FILLED, START, TRACK_FILLED, hourly, recursive, rounded, sql_greedy, sql_round, tracks

M, N = 24, 697
LAG = P.exclusion(M)
WINDOWS = f""", w0 AS (SELECT signal_id, bin_idx - o.o AS i, o.o AS o, value AS v FROM filled CROSS JOIN range({M}) o(o) WHERE bin_idx - o.o BETWEEN 0 AND {N - 1}),
zw AS MATERIALIZED (SELECT signal_id, i, o, (v - avg(v) OVER p) / sqrt({M} * var_pop(v) OVER p) AS z FROM w0 WINDOW p AS (PARTITION BY signal_id, i))"""
PROFILE = WINDOWS + f""", cr AS (SELECT a.signal_id, a.i, b.i AS j, sum(a.z * b.z) AS r FROM zw a JOIN zw b ON a.signal_id = b.signal_id AND a.o = b.o WHERE b.i - a.i > {LAG} GROUP BY ALL),
al AS (SELECT signal_id, i, j, r, 'right' AS side FROM cr UNION ALL SELECT signal_id, j, i, r, 'left' FROM cr),
mp AS (SELECT signal_id, i AS idx, sqrt(greatest(0, 2 * {M} * (1 - max(r)))) AS dist, arg_max(j, (round(r, 12), -j)) AS nn FROM al GROUP BY ALL)"""


def profile(t):
    return P.matrix_profile(hourly(t), M)


@query("p01_matrix_profile", sql_round(FILLED + PROFILE + " SELECT * FROM mp", "dist", 5))
def _(t):
    return rounded(profile(t), 5)


@query("p02_lr_profile", sql_round(FILLED + PROFILE + f""", sd AS (SELECT signal_id, i AS idx, side, sqrt(greatest(0, 2 * {M} * (1 - max(r)))) AS d, arg_max(j, (round(r, 12), -j)) AS n FROM al GROUP BY ALL)
SELECT signal_id, idx, max(d) FILTER (side = 'left') AS left_dist, max(n) FILTER (side = 'left') AS left_nn, max(d) FILTER (side = 'right') AS right_dist, max(n) FILTER (side = 'right') AS right_nn FROM sd GROUP BY ALL""", "left_dist right_dist", 5))
def _(t):
    return rounded(P.lr_matrix_profile(hourly(t), M), 5)


@query("p03_distance_profile", sql_round(FILLED + WINDOWS + f" SELECT b.signal_id, b.i AS idx, sqrt(greatest(0, 2 * {M} * (1 - sum(a.z * b.z)))) AS dist FROM zw a JOIN zw b USING (o) WHERE a.signal_id = 'click' AND a.i = 0 GROUP BY ALL", "dist", 5))
def _(t):
    from signalmill.plans.queries_patterns import pattern

    grid = hourly(t)
    return rounded(P.distance_profile(pattern(grid, "click", 0, M), grid), 5)


@query("p04_nn_scan", sql_round(FILLED + PROFILE + " SELECT * FROM mp", "dist", 5))
def _(t):
    grid = hourly(t)
    idxs = grid.select("signal_id", F.col("bin_idx").alias("idx"))
    return rounded(P.nn_scan(grid, M, idxs), 5)


MATERIAL = PROFILE.replace("mp AS (", "mp AS MATERIALIZED (")
PAIRS = MATERIAL + f""", pr AS MATERIALIZED (SELECT DISTINCT signal_id, least(idx, nn) AS a, greatest(idx, nn) AS b, round(dist, 9) AS d FROM mp WHERE nn IS NOT NULL),
pk AS (SELECT signal_id, 0 AS n, []::BIGINT[] AS taken FROM pr GROUP BY signal_id UNION ALL
 SELECT pk.signal_id, n + 1, list_concat(taken, (SELECT [a, b] FROM pr f WHERE f.signal_id = pk.signal_id AND len(list_filter(taken, lambda x: abs(x - a) < {LAG} OR abs(x - b) < {LAG})) = 0
  ORDER BY d, a, b LIMIT 1)) FROM pk WHERE n < 3)
SELECT pk.signal_id, r.r::INT AS rank, taken[2 * r.r - 1] AS idx_a, taken[2 * r.r] AS idx_b, d AS dist FROM pk CROSS JOIN range(1, 4) r(r)
 JOIN pr ON pr.signal_id = pk.signal_id AND pr.a = taken[2 * r.r - 1] AND pr.b = taken[2 * r.r] WHERE n = 3"""


@query("p05_motif_pairs", sql_round(recursive(FILLED + PAIRS), "dist", 5))
def _(t):
    return rounded(P.motif_pairs(profile(t), 3, LAG), 5)


def sql_picks(name: str, source: str, order: str, reach: int, k: int) -> str:
    """CTE ``name``: the picks of ``sql_greedy`` with their ``rank``."""
    body, last = sql_greedy(source, order, reach, k, rank="rank").rsplit("\nSELECT", 1)
    return f"{body.replace('pk AS', f'pk_{name} AS').replace('pk.', f'pk_{name}.').replace('FROM pk ', f'FROM pk_{name} ')}, {name} AS MATERIALIZED (SELECT{last.replace('FROM pk ', f'FROM pk_{name} ')})"


def sql_pairs(name: str, source: str, gap: int, k: int) -> str:
    """CTE ``name``: closest pairs of ``source`` (signal_id, idx, nn, dist) per signal, all endpoints ``gap`` apart."""
    return f""", pr_{name} AS MATERIALIZED (SELECT DISTINCT signal_id, least(idx, nn) AS a, greatest(idx, nn) AS b, round(dist, 9) AS d FROM {source} WHERE nn IS NOT NULL),
pk_{name} AS (SELECT signal_id, 0 AS n, []::BIGINT[] AS taken FROM pr_{name} GROUP BY signal_id UNION ALL
 SELECT p.signal_id, n + 1, list_concat(taken, (SELECT [a, b] FROM pr_{name} f WHERE f.signal_id = p.signal_id AND len(list_filter(taken, lambda x: abs(x - a) < {gap} OR abs(x - b) < {gap})) = 0
  ORDER BY d, a, b LIMIT 1)) FROM pk_{name} p WHERE n < {k}),
{name} AS MATERIALIZED (SELECT p.signal_id, r.r::INT AS rank, taken[2 * r.r - 1] AS idx_a, taken[2 * r.r] AS idx_b, d AS dist FROM pk_{name} p CROSS JOIN range(1, {k + 1}) r(r)
 JOIN pr_{name} q ON q.signal_id = p.signal_id AND q.a = taken[2 * r.r - 1] AND q.b = taken[2 * r.r] WHERE n = {k})"""


BEST = """ SELECT signal_id, arg_min(least(idx, nn), (dist, least(idx, nn))) AS idx_a, arg_min(greatest(idx, nn), (dist, least(idx, nn))) AS idx_b, min(dist) AS dist FROM mp GROUP BY signal_id"""


@query("p05_top_motif", sql_round(FILLED + PROFILE + BEST, "dist", 5))
def _(t):
    return rounded(P.motif_pairs(profile(t), 1, LAG).drop("rank"), 5)


@query("p06_motif_pruned", sql_round(FILLED + PROFILE + BEST, "dist", 5))
def _(t):
    return rounded(P.motif_pruned(hourly(t), M, segments=8), 5)


@query("p07_discords", sql_round(recursive(FILLED + MATERIAL + sql_greedy("mp", "round(dist, 9) DESC, idx", LAG, 3, rank="rank")), "dist", 5))
def _(t):
    return rounded(P.discords(profile(t), 3, LAG), 5)


@query("p07_top_discord", sql_round(FILLED + PROFILE + " SELECT signal_id, arg_max(idx, (dist, -idx)) AS idx, max(dist) AS dist FROM mp GROUP BY signal_id", "dist", 5))
def _(t):
    return rounded(P.discords(profile(t), 1, LAG).select("signal_id", "idx", "dist"), 5)


def motifs(t):
    grid = checkpointed(hourly(t))
    return grid, P.motif_pairs(P.matrix_profile(grid, M), 2, LAG)


OCCURRENCES = MATERIAL + sql_pairs("mo", "mp", LAG, 2) + f""", oc AS (SELECT mo.signal_id || '|' || rank AS signal_id, w.i AS idx, sqrt(greatest(0, 2 * {M} * (1 - sum(q.z * w.z)))) AS d, w.i = mo.idx_a AS seed, mo.dist AS pair
 FROM mo JOIN zw q ON q.signal_id = mo.signal_id AND q.i = mo.idx_a JOIN zw w ON w.signal_id = mo.signal_id AND w.o = q.o GROUP BY ALL),
close_by AS MATERIALIZED (SELECT signal_id, idx, d AS dist, CASE WHEN seed THEN -1 ELSE d END AS score FROM oc WHERE seed OR d <= pair * 1.5)""" + sql_picks("occ", "close_by", "score, idx", -(-M // 2) - 1, N // (M // 2) + 1)


@query("p09_occurrences", sql_round(recursive(FILLED + OCCURRENCES + " SELECT split_part(signal_id, '|', 1) AS signal_id, split_part(signal_id, '|', 2)::INT AS rank, idx, dist FROM occ"), "dist", 5))
def _(t):
    grid, pairs = motifs(t)
    return rounded(P.occurrences(grid, pairs, M), 5)


def sql_best(m: int) -> str:
    """The closest pair of windows of length ``m`` of each signal."""
    body = WINDOWS.replace(f"range({M})", f"range({m})").replace(f"AND {N - 1}", f"AND {720 - m}").replace(f"sqrt({M} *", f"sqrt({m} *").replace("w0", f"w0_{m}").replace("zw", f"zw_{m}")
    pairs = f"SELECT a.signal_id, a.i, b.i AS j, sum(a.z * b.z) AS r FROM zw_{m} a JOIN zw_{m} b ON a.signal_id = b.signal_id AND a.o = b.o WHERE b.i - a.i > {P.exclusion(m)} GROUP BY ALL"
    return body + f", cr_{m} AS ({pairs}), best_{m} AS (SELECT signal_id, {m} AS m, arg_max(i, (round(r, 12), -i, -j)) AS idx_a, arg_max(j, (round(r, 12), -i, -j)) AS idx_b, sqrt(greatest(0, 2 * {m} * (1 - max(r)))) AS dist FROM cr_{m} GROUP BY signal_id)"


@query("p10_pan_motifs", sql_round(FILLED + "".join(map(sql_best, (12, 24, 36))) + " SELECT *, (row_number() OVER (PARTITION BY signal_id ORDER BY dist / sqrt(m), m))::INT AS rank FROM (FROM best_12 UNION ALL FROM best_24 UNION ALL FROM best_36)", "dist", 5))
def _(t):
    return rounded(P.pan_motifs(checkpointed(hourly(t)), P.pan_lengths(12, 36, 12), 3), 5)


ARCS = PROFILE + f""", ar AS (SELECT signal_id, least(idx, nn) + 1 AS p, 1 AS d FROM mp UNION ALL SELECT signal_id, greatest(idx, nn) + 1, -1 FROM mp),
ap AS (SELECT signal_id, p, sum(d) AS d FROM ar GROUP BY ALL),
ac AS (SELECT mp.signal_id, idx, sum(coalesce(d, 0)) OVER (PARTITION BY mp.signal_id ORDER BY idx)::BIGINT AS arcs FROM mp LEFT JOIN ap ON ap.signal_id = mp.signal_id AND ap.p = idx),
cv AS (SELECT *, CASE WHEN idx < {M} OR idx >= {N} - {M} OR idx = 0 THEN 1.0 ELSE least(1, arcs / (2.0 * idx * ({N} - idx) / {N})) END AS cac FROM ac)"""


@query("p11_arc_curve", sql_round(FILLED + ARCS + " SELECT * FROM cv", "cac"))
def _(t):
    return rounded(P.arc_curve(profile(t), M))


@query("p11_first_regime", sql_round(FILLED + ARCS + " SELECT signal_id, arg_min(idx, (cac, idx)) AS idx, min(cac) AS cac FROM cv WHERE cac < 1 GROUP BY signal_id", "cac"))
def _(t):
    return rounded(P.regimes(profile(t), 1, M).drop("rank"))


@query("p11_regimes", sql_round(recursive(FILLED + ARCS + ", dips AS MATERIALIZED (SELECT signal_id, idx, cac FROM cv WHERE cac < 1)" + sql_greedy("dips", "cac, idx", M, 3, rank="rank")), "cac"))
def _(t):
    return rounded(P.regimes(profile(t), 3, M))


CHAINS = PROFILE + """, lr AS MATERIALIZED (SELECT signal_id, i AS idx, arg_max(j, (round(r, 12), -j)) FILTER (side = 'left') AS left_nn, arg_max(j, (round(r, 12), -j)) FILTER (side = 'right') AS right_nn FROM al GROUP BY ALL),
lk AS MATERIALIZED (SELECT a.signal_id, a.idx AS prev, b.idx FROM lr a JOIN lr b ON a.signal_id = b.signal_id AND a.right_nn = b.idx AND b.left_nn = a.idx),
ch AS (SELECT signal_id, idx AS head, idx, 0::BIGINT AS pos FROM lr WHERE NOT EXISTS (FROM lk WHERE lk.signal_id = lr.signal_id AND lk.idx = lr.idx)
 UNION ALL SELECT ch.signal_id, head, lk.idx, pos + 1 FROM ch JOIN lk ON lk.signal_id = ch.signal_id AND lk.prev = ch.idx),
cl AS (SELECT signal_id, head, max(pos) + 1 AS length, max(idx) AS ending FROM ch GROUP BY ALL),
cb AS (SELECT *, (row_number() OVER (PARTITION BY signal_id ORDER BY length DESC, ending))::INT AS rank FROM cl),
cx AS (SELECT signal_id, rank, pos, idx, length FROM ch JOIN cb USING (signal_id, head) WHERE rank <= 2 AND (length > 1 OR rank = 1))"""


@query("p12_chains", recursive(FILLED + CHAINS + " SELECT * FROM cx"))
def _(t):
    return P.chains(P.lr_matrix_profile(hourly(t), M), 2)


DRIFT = CHAINS + f""", ws AS (SELECT signal_id, i AS idx, avg(v) AS mean, max(v) - min(v) AS swing FROM w0 GROUP BY ALL),
dr AS (SELECT signal_id, rank, count(*) AS links, arg_min(mean, pos) AS mean_start, arg_max(mean, pos) AS mean_end, coalesce(regr_slope(mean, pos), 0) AS mean_slope,
 arg_min(swing, pos) AS amplitude_start, arg_max(swing, pos) AS amplitude_end, coalesce(regr_slope(swing, pos), 0) AS amplitude_slope FROM cx JOIN ws USING (signal_id, idx) GROUP BY ALL),
de AS (SELECT *, greatest(abs(mean_end - mean_start) / greatest(abs(mean_start), abs(mean_end), 1e-9), abs(amplitude_end - amplitude_start) / greatest(abs(amplitude_start), abs(amplitude_end), 1e-9)) AS moved,
 CASE WHEN abs(amplitude_slope) > abs(mean_slope) THEN amplitude_slope ELSE mean_slope END AS slope FROM dr)
SELECT * EXCLUDE (moved, slope), CASE WHEN links < 3 THEN 'weak' WHEN moved > 0.4 AND links >= 4 THEN 'strong' WHEN moved > 0.15 THEN 'moderate' ELSE 'weak' END AS strength,
 CASE WHEN slope > 0 THEN 'rising' WHEN slope < 0 THEN 'falling' ELSE 'flat' END AS drift_direction FROM de"""


@query("p12_chain_drift", sql_round(recursive(FILLED + DRIFT), "mean_start mean_end mean_slope amplitude_start amplitude_end amplitude_slope", 5))
def _(t):
    grid = checkpointed(hourly(t))
    return rounded(P.drift_strength(P.chain_drift(P.chains(P.lr_matrix_profile(grid, M), 2), grid, M)), 5)


AB = WINDOWS + f""", ab AS (SELECT a.i, b.i AS j, sum(a.z * b.z) AS r FROM zw a JOIN zw b ON a.o = b.o WHERE a.signal_id = 'click' AND b.signal_id = 'view' GROUP BY ALL),
abp AS (SELECT 'a' AS series, i AS idx, sqrt(greatest(0, 2 * {M} * (1 - max(r)))) AS dist, arg_max(j, (round(r, 12), -j)) AS nn FROM ab GROUP BY i UNION ALL SELECT 'b', j, sqrt(greatest(0, 2 * {M} * (1 - max(r)))), arg_max(i, (round(r, 12), -i)) FROM ab GROUP BY j)"""


@query("p13_ab_profile", sql_round(FILLED + AB + " SELECT * FROM abp", "dist", 5))
def _(t):
    return rounded(P.ab_profile(hourly(t), "click", "view", M), 5)


@query("j11_nn_join", sql_round(FILLED + AB + " SELECT * FROM abp WHERE series = 'a'", "dist", 5))
def _(t):
    return rounded(P.ab_profile(hourly(t), "click", "view", M).filter("series = 'a'"), 5)


AB_PAIRS = AB + f""", pr AS MATERIALIZED (SELECT idx AS a, nn AS b, dist AS d FROM abp WHERE series = 'a'),
pk AS (SELECT 0 AS n, []::BIGINT[] AS taken UNION ALL SELECT n + 1, list_concat(taken, (SELECT [a, b] FROM pr
  WHERE len(list_filter(taken, lambda x, i: (i % 2 = 1 AND abs(x - a) < {LAG}) OR (i % 2 = 0 AND abs(x - b) < {LAG}))) = 0 ORDER BY round(d, 9), a, b LIMIT 1)) FROM pk WHERE n < 3)
SELECT r.r::INT AS rank, a AS idx_a, b AS idx_b, d AS dist FROM pk CROSS JOIN range(1, 4) r(r) JOIN pr ON a = taken[2 * r.r - 1] AND b = taken[2 * r.r] WHERE n = 3"""


@query("p13_ab_motifs", sql_round(recursive(FILLED + AB_PAIRS), "dist", 5))
def _(t):
    return rounded(P.ab_motifs(P.ab_profile(hourly(t), "click", "view", M), 3, LAG), 5)


@query("p13_ab_discords", sql_round(recursive(FILLED + AB + ", tb AS MATERIALIZED (SELECT series AS signal_id, idx, dist, nn FROM abp WHERE series = 'b')" + sql_picks("far", "tb", "round(dist, 9) DESC, idx", LAG, 3) + " SELECT signal_id AS series, idx, dist, nn, rank FROM far"), "dist", 5))
def _(t):
    return rounded(P.ab_discords(P.ab_profile(hourly(t), "click", "view", M), 3, LAG), 5)


def channels(t):
    return search_space(tracks(t), START, END, 3 * HOUR, by=P.TRACK)


CHANNELS = TRACK_FILLED + """, w0 AS (SELECT split_part(signal_id, '|', 1) AS entity_id, split_part(signal_id, '|', 2) AS track_id, bin_idx - o.o AS i, o.o AS o, value AS v FROM filled CROSS JOIN range(16) o(o) WHERE bin_idx - o.o BETWEEN 0 AND 224),
zw AS MATERIALIZED (SELECT entity_id, track_id, i, o, (v - avg(v) OVER p) / sqrt(16 * var_pop(v) OVER p) AS z FROM w0 WINDOW p AS (PARTITION BY entity_id, track_id, i)),
ds AS (SELECT a.entity_id, a.track_id, a.i, b.i AS j, sqrt(greatest(0, 32 * (1 - sum(a.z * b.z)))) AS d FROM zw a JOIN zw b ON a.entity_id = b.entity_id AND a.track_id = b.track_id AND a.o = b.o WHERE abs(a.i - b.i) > 4 GROUP BY ALL),
kd AS (SELECT entity_id, i, j, row_number() OVER w AS k, avg(d) OVER (w ROWS UNBOUNDED PRECEDING) AS d FROM ds WINDOW w AS (PARTITION BY entity_id, i, j ORDER BY d))"""


@query("p14_mstamp", sql_round(CHANNELS + " SELECT entity_id, k::INT AS k, i AS idx, min(d) AS dist, arg_min(j, d) AS nn FROM kd GROUP BY ALL", "dist", 5))
def _(t):
    return rounded(P.mstamp(channels(t), 16), 5)


def sql_depth(k: int) -> str:
    """CTE ``mk``: the profile over the ``k`` nearest channels, by entity."""
    return CHANNELS.replace("ds AS (", "ds AS MATERIALIZED (") + f", mk AS MATERIALIZED (SELECT entity_id AS signal_id, i AS idx, min(d) AS dist, arg_min(j, d) AS nn FROM kd WHERE k = {k} GROUP BY ALL)"


def sql_dims(source: str, a: str, b: str) -> str:
    """CTE ``dm``: the three channels nearest at each row of ``source``, in order."""
    return f""", dm AS (SELECT signal_id, rank, string_agg(track_id, ',' ORDER BY n) AS dims FROM (SELECT s.signal_id, rank, track_id, row_number() OVER (PARTITION BY s.signal_id, rank ORDER BY d, track_id) AS n
 FROM {source} s JOIN ds ON ds.entity_id = s.signal_id AND ds.i = {a} AND ds.j = {b}) WHERE n <= 3 GROUP BY ALL)"""


DEEP_PAIRS = sql_depth(3) + sql_pairs("mo", "mk", P.exclusion(16), 2) + sql_dims("mo", "idx_a", "idx_b")


@query("p14_mstamp_motifs", sql_round(recursive(DEEP_PAIRS + " SELECT signal_id AS entity_id, rank, idx_a, idx_b, dist, dims FROM mo JOIN dm USING (signal_id, rank)"), "dist", 5))
def _(t):
    grid = checkpointed(channels(t))
    pairs = P.mstamp_motifs(P.mstamp(grid, 16, [3]), grid, 16, 2, 3)
    return rounded(pairs.withColumn("dims", F.array_join("dims", ",")).drop("dim_dists"), 5)


@query("p14_mstamp_discords", sql_round(recursive(sql_depth(3) + sql_picks("far", "mk", "round(dist, 9) DESC, idx", P.exclusion(16), 2) + sql_dims("far", "s.idx", "s.nn") + " SELECT signal_id AS entity_id, rank, idx, nn, dist, dims FROM far JOIN dm USING (signal_id, rank)"), "dist", 5))
def _(t):
    grid = checkpointed(channels(t))
    picks = P.mstamp_discords(P.mstamp(grid, 16, [3]), grid, 16, 2, 3)
    return rounded(picks.withColumn("dims", F.array_join("dims", ",")).drop("dim_dists"), 5)


DEEP_OCCURRENCES = DEEP_PAIRS + """, oc AS (SELECT mo.signal_id, w.i AS idx, w.track_id, sqrt(greatest(0, 32 * (1 - sum(q.z * w.z)))) AS d, w.i = mo.idx_a AS seed, mo.dist AS pair FROM mo JOIN dm USING (signal_id, rank)
 JOIN zw q ON q.entity_id = mo.signal_id AND q.i = mo.idx_a AND list_contains(string_split(dims, ','), q.track_id) JOIN zw w ON w.entity_id = q.entity_id AND w.track_id = q.track_id AND w.o = q.o WHERE rank = 1 GROUP BY ALL),
om AS (SELECT signal_id, idx, avg(d) AS dist, seed, pair FROM oc GROUP BY ALL),
close_by AS MATERIALIZED (SELECT signal_id, idx, dist, CASE WHEN seed THEN -1 ELSE dist END AS score FROM om WHERE seed OR dist <= pair * 1.5)""" + sql_picks("occ", "close_by", "score, idx", 7, 30)


@query("p15_multidim_occurrences", sql_round(recursive(DEEP_OCCURRENCES + " SELECT signal_id AS entity_id, 1 AS rank, idx, dist FROM occ"), "dist", 5))
def _(t):
    grid = checkpointed(channels(t))
    pairs = checkpointed(P.mstamp_motifs(P.mstamp(grid, 16, [3]), grid, 16, 1, 3))
    return rounded(P.multidim_occurrences(grid, pairs, 16), 5)


DEEP_ARCS = sql_depth(5) + """, ar AS (SELECT signal_id, least(idx, nn) + 1 AS p, 1 AS d FROM mk UNION ALL SELECT signal_id, greatest(idx, nn) + 1, -1 FROM mk),
ap AS (SELECT signal_id, p, sum(d) AS d FROM ar GROUP BY ALL),
ac AS (SELECT mk.signal_id, idx, sum(coalesce(d, 0)) OVER (PARTITION BY mk.signal_id ORDER BY idx)::BIGINT AS arcs FROM mk LEFT JOIN ap ON ap.signal_id = mk.signal_id AND ap.p = idx),
cv AS (SELECT *, CASE WHEN idx < 16 OR idx >= 225 - 16 THEN 1.0 ELSE least(1, arcs / (2.0 * idx * (225 - idx) / 225)) END AS cac FROM ac),
dips AS MATERIALIZED (SELECT signal_id, idx, cac FROM cv WHERE cac < 1)""" + sql_picks("low", "dips", "cac, idx", 16, 2)


@query("p16_multidim_regimes", sql_round(recursive(DEEP_ARCS + " SELECT signal_id AS entity_id, idx, cac, rank FROM low"), "cac", 5))
def _(t):
    return rounded(P.multidim_regimes(P.mstamp(channels(t), 16, [5]), 16, 2, 5), 5)


@query("p17_consensus_motif", sql_round(FILLED + WINDOWS + f""", cs AS (SELECT a.signal_id AS s, b.signal_id AS t, a.i, b.i AS j, sum(a.z * b.z) AS r FROM zw a JOIN zw b ON a.o = b.o AND a.signal_id <> b.signal_id GROUP BY ALL),
nb AS (SELECT s, t, i, sqrt(greatest(0, 2 * {M} * (1 - max(r)))) AS d, arg_max(j, (round(r, 12), -j)) AS j FROM cs GROUP BY ALL),
rd AS (SELECT s, i, list_sort(list(d))[3] AS radius FROM nb GROUP BY ALL), bs AS (SELECT * FROM rd ORDER BY radius, s, i LIMIT 1)
SELECT s AS central_series, i AS central_idx, radius, nb.t AS signal_id, nb.j AS idx, nb.d AS dist, false AS is_central FROM bs JOIN nb USING (s, i)
UNION ALL SELECT s, i, radius, s, i, 0, true FROM bs""", "radius dist", 5))
def _(t):
    return rounded(P.consensus_motif(hourly(t), M, 4), 5)


@query("p18_analyze_full", recursive(FILLED + OCCURRENCES + " SELECT 'job-1' AS job_id, split_part(signal_id, '|', 1) AS signal_id, count(*) AS n FROM occ GROUP BY ALL"))
def _(t):
    out = P.analyze("full_mp", checkpointed(hourly(t)), "job-1", M, 2)
    return out["motif_occurrences"].groupBy("job_id", "signal_id").agg(F.count(F.lit(1)).alias("n"))


@query("p18_analyze_segmentation", sql_round(recursive(FILLED + ARCS + ", dips AS MATERIALIZED (SELECT signal_id, idx, cac FROM cv WHERE cac < 1)" + sql_picks("low", "dips", "cac, idx", M, 2) + " SELECT *, 'job-2' AS job_id FROM low"), "cac"))
def _(t):
    return rounded(P.analyze("segmentation", checkpointed(hourly(t)), "job-2", M, 2)["segments"])


@query("p19_result_rows", sql_round(FILLED + PROFILE + " SELECT *, 'job-1' AS job_id, dist / max(dist) OVER (PARTITION BY signal_id) AS severity FROM mp", "dist severity", 5))
def _(t):
    return rounded(P.result_rows(profile(t), "job-1"), 5)


@query("p20_strength_labels", sql_round(FILLED + PROFILE + f""" SELECT signal_id, idx, CASE WHEN dist / sqrt({M}) < 0.15 THEN 'strong' WHEN dist / sqrt({M}) < 0.35 THEN 'moderate' ELSE 'weak' END AS motif,
 greatest(0, least(100, floor((1 - dist / sqrt({M}) / 0.5) * 100 + 0.5)))::DOUBLE AS consistency_pct, greatest(0, least(1, (dist / 3 - 1) / 2)) AS severity FROM mp""", "severity", 4))
def _(t):
    mp = profile(t)
    d = F.col("dist")
    return rounded(mp.select("signal_id", "idx", P.motif_strength(d, M).alias("motif"), P.consistency_pct(d, M).alias("consistency_pct"), P.discord_severity(d, F.lit(3.0)).alias("severity")), 4)


@query("p21_propagate_label")
def _(t):
    mp = checkpointed(profile(t))
    seeds = P.motif_pairs(mp, 1, LAG).select("signal_id", F.col("idx_a").alias("seed"))
    return rounded(P.propagate_label(mp, P.suggest_threshold(mp, seeds), M, LAG), 5)


@query("a08_write_results", sql_round(FILLED + PROFILE + " SELECT *, 'job-1' AS job_id FROM mp", "dist", 5))
def _(t):
    from signalmill.plans.runtime import shared_folder
    from signalmill.sources.telemetry import write_results
    import uuid

    path = f"{shared_folder(t.spark)}/results-{uuid.uuid4().hex}"
    write_results({"mp_result": profile(t)}, path, "job-1")
    return rounded(t.spark.read.parquet(f"{path}/mp_result"), 5)


@query("a09_read_result", sql_round(FILLED + """ SELECT signal_id, level, bucket, t_min, t_max, t_avg, start_idx, 'job-1' AS job_id FROM (
 SELECT signal_id, 1 AS level, bin_idx // 32 AS bucket, min(value) AS t_min, max(value) AS t_max, avg(value) AS t_avg, bin_idx // 32 * 32 AS start_idx FROM filled GROUP BY ALL) WHERE bucket BETWEEN 3 AND 9""", "t_min t_max t_avg"))
def _(t):
    from signalmill.plans.runtime import shared_folder
    from signalmill.sources.telemetry import read_result, write_results
    import uuid

    path = f"{shared_folder(t.spark)}/results-{uuid.uuid4().hex}"
    write_results({"overview": overview(hourly(t))}, path, "job-1")
    table = t.spark.read.parquet(f"{path}/overview")
    return rounded(read_result(table, "job-1", 3, 9, "bucket", level=1))
