"""Symbolic search, discords, classification and cycles over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalmill.functions import symbols as Y
from signalmill.functions.ordered import known_bins, mark_bins
from signalmill.functions.timeparts import DAY, HOUR, floor_div, from_us
from signalmill.operators import similarity as X, windows as W
from signalmill.operators.grid import make_series, search_space
from signalmill.operators.multivariate import TRACK
from signalmill.plans.queries_relate import reading_dim
from signalmill.plans.registry import query
from signalmill.plans.samples import (
    END, FILLED, SIGNALS, START, TRACK_FILLED, USER_FILLED, USERS, hourly, recursive, rounded, signals, sql_greedy, sql_round, tracks, user_daily, user_signals,
)

G4 = "-0.6744897501960817, 0.0, 0.6744897501960817"
LETTER = "substr('abcd', 1 + ({v} + 1e-9::DOUBLE >= {a})::INT + ({v} + 1e-9::DOUBLE >= {b})::INT + ({v} + 1e-9::DOUBLE >= {c})::INT, 1)"


def letter(v: str, cuts=("-0.6744897501960817", "0", "0.6744897501960817")) -> str:
    return LETTER.format(v=v, a=cuts[0], b=cuts[1], c=cuts[2])


# ---------------------------------------------------------------- scalar and array functions

ZN = """, zn AS (SELECT *, CASE WHEN sd >= 0.01 THEN (value - m) / sd ELSE value - m END AS z FROM (SELECT *, avg(value) OVER s AS m, stddev_pop(value) OVER s AS sd FROM filled WINDOW s AS (PARTITION BY signal_id)))"""


@query("s08_znorm", sql_round(USER_FILLED + ZN + " SELECT signal_id, bin_idx, ts, value, z FROM zn", "value z"))
def _(t):
    return rounded(W.znorm(user_daily(t)))


@query("s08b_znorm_zero", sql_round(USER_FILLED + ZN + " SELECT signal_id, bin_idx, ts, value, CASE WHEN sd < 20 THEN 0 ELSE (value - m) / sd END AS z FROM zn", "value z"))
def _(t):
    return rounded(W.znorm_zero(user_daily(t), 20.0))


@query("s09_paa_fractional", sql_round(USER_FILLED + """, ov AS (SELECT signal_id, p.p AS segment, value, least(bin_idx + 1.0::DOUBLE, (p.p + 1) * 30 / 7.0::DOUBLE) - greatest(bin_idx::DOUBLE, p.p * 30 / 7.0::DOUBLE) AS w FROM filled CROSS JOIN range(7) p(p))
SELECT signal_id, segment, sum(value * w) / sum(w) AS paa FROM ov WHERE w > 0 GROUP BY ALL""", "paa"))
def _(t):
    return rounded(W.paa_fractional(user_daily(t), 7))


@query("s10_paa_integer", sql_round(USER_FILLED + " SELECT signal_id, ((bin_idx + 1) * 7 - 1) // 30 AS segment, avg(value) AS paa FROM filled GROUP BY ALL", "paa"))
def _(t):
    return rounded(W.paa_integer(user_daily(t), 7))


@query("s11_paa_truncate", sql_round(USER_FILLED + " SELECT signal_id, bin_idx // 4 AS segment, avg(value) AS paa FROM filled WHERE bin_idx < 28 GROUP BY ALL", "paa"))
def _(t):
    return rounded(W.paa_truncate(user_daily(t), 7))


@query("s12_gaussian_symbol", sql_round(USER_FILLED + ZN + f" SELECT signal_id, bin_idx, {letter('z')} AS symbol FROM zn", "bin_idx").replace("round(bin_idx + 3.7e-09, 6) + 0.0 AS bin_idx", "bin_idx AS bin_idx"))
def _(t):
    z = W.znorm(user_daily(t))
    return z.select("signal_id", "bin_idx", Y.symbolize(F.array("z"), Y.gaussian_breakpoints(4)).alias("symbol"))


@query("s13_query_breakpoints", sql_round(f"""WITH {USERS}, r AS (SELECT signal_id, value, row_number() OVER (PARTITION BY signal_id ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY signal_id) AS n FROM raw)
SELECT signal_id AS query_id, max(value) FILTER (r = least(n - 1, n // 4)) AS b1, max(value) FILTER (r = least(n - 1, 2 * n // 4)) AS b2, max(value) FILTER (r = least(n - 1, 3 * n // 4)) AS b3 FROM r GROUP BY signal_id""", "b1 b2 b3"))
def _(t):
    rows = user_signals(t).withColumnRenamed("signal_id", "query_id")
    cuts = Y.query_breakpoints(rows, 4)
    return rounded(cuts.select("query_id", *[F.col("breakpoints")[i].alias(f"b{i}") for i in (1, 2, 3)]))


USER_WORDS = USER_FILLED + ZN + f""", pa AS (SELECT signal_id, ((bin_idx + 1) * 6 - 1) // 30 AS seg, avg(z) AS v FROM zn GROUP BY ALL),
uw AS (SELECT signal_id, string_agg({letter('v')}, '' ORDER BY seg) AS word FROM pa GROUP BY signal_id)"""


def user_words(t):
    z = W.znorm(user_daily(t))
    return W.series_word(W.paa_integer(z, 6, "z"), Y.gaussian_breakpoints(4))


@query("s14_symbolize", USER_WORDS + " SELECT * FROM uw")
def _(t):
    return user_words(t).select("signal_id", "word")


@query("s15_euclidean", sql_round("SELECT a.vec_id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", "distance", 5))
def _(t):
    a = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return rounded(a.join(b, "vec_id").select("vec_id", Y.euclidean(F.col("a"), F.col("b")).alias("distance")), 5)


NEXT = """, nx AS (SELECT a.signal_id, a.word AS wa, b.word AS wb FROM uw a JOIN uw b ON b.signal_id = 'u' || (substr(a.signal_id, 2)::BIGINT + 1)),
gp AS (SELECT signal_id, wa, wb, p.p, ascii(substr(wa, p.p::INT, 1)) - 97 AS ca, ascii(substr(wb, p.p::INT, 1)) - 97 AS cb FROM nx CROSS JOIN range(1, 7) p(p))"""


def neighbours(t):
    a = user_words(t).select("signal_id", F.col("word").alias("wa"))
    b = a.select(F.concat(F.lit("u"), (F.substring("signal_id", 2, 20).cast("bigint") - 1).cast("string")).alias("signal_id"), F.col("wa").alias("wb"))
    return a.join(b, "signal_id")


@query("s16_word_distance", sql_round(USER_WORDS + NEXT + " SELECT signal_id, avg(abs(ca - cb)) AS mean_gap, max(abs(ca - cb))::DOUBLE AS max_gap FROM gp GROUP BY signal_id", "mean_gap max_gap"))
def _(t):
    a, b = F.col("wa"), F.col("wb")
    return rounded(neighbours(t).select("signal_id", Y.word_distance(a, b).alias("mean_gap"), Y.word_distance(a, b, "max").alias("max_gap")))


@query("s17_tolerance_regex", USER_WORDS + """, tr AS (SELECT signal_id, word, string_agg('[' || substr('abcd', greatest(0, c - 1) + 1, least(3, c + 1) - greatest(0, c - 1) + 1) || ']', '' ORDER BY p) AS pattern
 FROM (SELECT signal_id, word, p.p, (ascii(substr(word, p.p::INT, 1)) - 97)::INT AS c FROM uw CROSS JOIN range(1, 7) p(p)) GROUP BY ALL)
SELECT signal_id, pattern, (SELECT count(*) FROM uw WHERE regexp_full_match(uw.word, tr.pattern)) AS hits FROM tr""")
def _(t):
    words = user_words(t).select("signal_id", "word")
    patterns = words.withColumn("pattern", Y.tolerance_regex(F.col("word"), 4, 1))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("word", "_w")
    # distinct words meet distinct patterns: both are bounded by the alphabet, not by the data
    kinds = patterns.select("pattern").distinct().join(counts, F.expr("_w rlike concat('^', pattern, '$')"))
    hits = kinds.groupBy("pattern").agg(F.sum("_n").alias("hits"))
    return patterns.join(hits, "pattern").select("signal_id", "pattern", "hits")


@query("s18_similarity", sql_round("SELECT event_id, 1 / (1 + value) AS similarity FROM events", "similarity"))
def _(t):
    return rounded(t.events.select("event_id", Y.similarity(F.col("value")).alias("similarity")))


def _mindist_sql(src: str, key: str, n: int, length: int) -> str:
    cuts = "[-0.67, 0.0, 0.67]"
    gap = f"CASE WHEN abs(ca - cb) <= 1 THEN 0.0 ELSE {cuts}[greatest(ca, cb)] - {cuts}[least(ca, cb) + 1] END"
    return f"SELECT {key}, sqrt({length} / {n}.0::DOUBLE) * sqrt(sum(pow(({gap})::DOUBLE, 2))) AS distance FROM {src} GROUP BY ALL"


@query("s19_mindist", sql_round(USER_WORDS + NEXT + " " + _mindist_sql("gp", "signal_id", 6, 30), "distance"))
def _(t):
    return rounded(neighbours(t).select("signal_id", Y.mindist(F.col("wa"), F.col("wb"), 4, 30).alias("distance")))


@query("s28_resample", sql_round(f"""WITH {USERS}, p AS (SELECT signal_id, value, row_number() OVER (PARTITION BY signal_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY signal_id) AS n FROM raw),
w AS (SELECT DISTINCT signal_id, n, q.q AS point, q.q * (n - 1) / 15.0::DOUBLE AS pos FROM p CROSS JOIN range(16) q(q))
SELECT w.signal_id, point::INT AS point, a.value * (1 - (pos - floor(pos))) + b.value * (pos - floor(pos)) AS value FROM w JOIN p a ON a.signal_id = w.signal_id AND a.i = floor(pos)
 JOIN p b ON b.signal_id = w.signal_id AND b.i = least(floor(pos) + 1, w.n - 1)""", "value"))
def _(t):
    from signalmill.functions.ordered import ordinal
    from signalmill.functions.timeparts import to_us

    rows = ordinal(user_signals(t), "signal_id", ["ts"], floor_div(to_us("ts"), DAY), name="pos")
    return rounded(W.resample(rows, 16, ["signal_id"]))


@query("s29_index_to_time", """SELECT event_id, event_id % 700 AS start_index, 1 + event_id % 50 AS length, TIMESTAMP '2024-01-01' + to_hours((event_id % 700)::INT) AS start_ts,
 least(TIMESTAMP '2024-01-31', TIMESTAMP '2024-01-01' + to_hours((event_id % 700 + 1 + event_id % 50)::INT)) AS end_ts FROM events""")
def _(t):
    spans = t.events.select("event_id", (F.col("event_id") % 700).alias("start_index"), (F.col("event_id") % 50 + 1).alias("length"))
    return W.index_to_time(spans, START, END, 720)


# ---------------------------------------------------------------- windows, words and search

SEGS = ", ".join(f"avg(value) OVER (o ROWS BETWEEN {6 * k} FOLLOWING AND {6 * k + 5} FOLLOWING) AS s{k}" for k in range(4))
WINDOWS = f""", wn AS (SELECT signal_id, bin_idx AS start_index, bin_idx + 23 AS end_index, {SEGS}, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS c FROM filled
 WINDOW o AS (PARTITION BY signal_id ORDER BY bin_idx), w AS (PARTITION BY signal_id ORDER BY bin_idx ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)),
pw AS (SELECT signal_id, start_index, end_index, {', '.join(f'(s{k} - m) / (CASE WHEN sd >= 0.01 THEN sd ELSE 1 END) AS p{k}' for k in range(4))} FROM wn WHERE c = 24),
sw AS (SELECT *, {' || '.join(letter(f'p{k}') for k in range(4))} AS word FROM pw)"""


@query("x09_sax_windows", sql_round(FILLED + WINDOWS + " SELECT * FROM sw", "p0 p1 p2 p3"))
def _(t):
    rows = W.sax_windows(hourly(t), 24, 4, Y.gaussian_breakpoints(4))
    return rounded(rows.select("signal_id", "start_index", "end_index", *[F.col("paa")[k].alias(f"p{k}") for k in range(4)], "word"))


@query("x10_word_counts", FILLED + WINDOWS + " SELECT signal_id, word, count(*) AS word_frequency FROM sw GROUP BY ALL")
def _(t):
    return X.word_counts(W.sax_windows(hourly(t), 24, 4, Y.gaussian_breakpoints(4)))


def pattern(grid, signal: str, first: int, length: int) -> list[float]:
    """A short search pattern: the values of one window."""
    rows = grid.filter((F.col("signal_id") == signal) & F.col("bin_idx").between(first, first + length - 1))
    return [r["value"] for r in rows.orderBy("bin_idx").select("value").collect()]


QUERY = WINDOWS + f""", qv AS (SELECT bin_idx AS i, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z FROM filled WHERE signal_id = 'click' AND bin_idx < 24),
qp AS (SELECT {', '.join(f'avg(z) FILTER (i // 6 = {k}) AS q{k}' for k in range(4))} FROM qv),
qo AS (SELECT z, row_number() OVER (ORDER BY z) - 1 AS r FROM qv),
qb AS (SELECT max(z) FILTER (r = 6) AS b1, max(z) FILTER (r = 12) AS b2, max(z) FILTER (r = 18) AS b3 FROM qo),
ds AS (SELECT pw.*, sqrt({' + '.join(f'(p{k} - q{k}) * (p{k} - q{k})' for k in range(4))}) AS distance, {' || '.join(letter(f'p{k}', ('b1', 'b2', 'b3')) for k in range(4))} AS candidate_word,
 {' || '.join(letter(f'q{k}', ('b1', 'b2', 'b3')) for k in range(4))} AS query_word FROM pw CROSS JOIN qp CROSS JOIN qb),
dg AS (SELECT *, greatest({', '.join(f'abs(ascii(substr(candidate_word, {k + 1}, 1)) - ascii(substr(query_word, {k + 1}, 1)))' for k in range(4))})::DOUBLE AS symbolic_distance FROM ds)"""
HITS = """SELECT signal_id, start_index, end_index, query_word, candidate_word, symbolic_distance, round(distance + 3.7e-9, 6) AS distance, (row_number() OVER (ORDER BY 1 / (1 + distance) DESC, distance, signal_id, start_index))::INT AS rank FROM dg"""
SHOWN = ["signal_id", "start_index", "end_index", "query_word", "candidate_word", "symbolic_distance", "distance", "rank"]


@query("x01_similarity_1d", FILLED + QUERY + f" SELECT * FROM ({HITS}) WHERE rank <= 20")
def _(t):
    grid = hourly(t)
    return rounded(X.similarity_1d(pattern(grid, "click", 0, 24), grid, segments=4, alpha=4, k=20).select(*SHOWN))


@query("x01_similarity_tolerance", FILLED + QUERY + f" SELECT * FROM ({HITS} WHERE symbolic_distance <= 1) WHERE rank <= 20")
def _(t):
    grid = hourly(t)
    return rounded(X.similarity_1d(pattern(grid, "click", 0, 24), grid, segments=4, alpha=4, k=20, tolerance=1).select(*SHOWN))


@query("x02_window_distances", sql_round(FILLED + QUERY + " SELECT signal_id, start_index, distance, symbolic_distance FROM dg", "distance"))
def _(t):
    grid = hourly(t)
    q = X.Query(pattern(grid, "click", 0, 24), 4, 4, 0.01)
    return rounded(X.scored_windows(grid, q, 4, 1.0, 1.0, 1, 0.01, ["signal_id"]).select("signal_id", "start_index", "distance", "symbolic_distance"))


@query("j09_score_candidates", sql_round(FILLED + WINDOWS + """, nd AS (SELECT c.signal_id, c.start_index, w.start_index AS j, sqrt(pow(c.p0 - w.p0, 2) + pow(c.p1 - w.p1, 2) + pow(c.p2 - w.p2, 2) + pow(c.p3 - w.p3, 2)) AS d FROM pw c JOIN pw w ON c.signal_id = w.signal_id AND abs(c.start_index - w.start_index) >= 24)
SELECT signal_id, start_index, min(d) AS nn_distance FROM nd GROUP BY ALL""", "nn_distance"))
def _(t):
    rows = W.window_means(hourly(t), 24, 4).drop("end_index")
    return rounded(X.score_candidates(rows, rows, 24).drop("nearest_neighbor_start"))


@query("x01_similarity_scales")
def _(t):
    grid = hourly(t)
    hits = X.similarity_1d(pattern(grid, "click", 0, 24), grid, 4, 4, low=0.9, high=1.1, steps=3, k=20)
    return rounded(hits.select(*SHOWN, "scale", "matched_length"))


@query("x22_consolidate", FILLED + QUERY + f""", h AS (SELECT * FROM ({HITS}) WHERE rank <= 60),
hc AS (SELECT *, CASE WHEN start_index > max(end_index) OVER (PARTITION BY signal_id ORDER BY start_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS nw FROM h),
hk AS (SELECT *, sum(nw) OVER (PARTITION BY signal_id ORDER BY start_index) AS cl FROM hc)
SELECT signal_id, start_index, end_index, distance FROM hk QUALIFY row_number() OVER (PARTITION BY signal_id, cl ORDER BY distance, start_index) = 1""")
def _(t):
    grid = hourly(t)
    hits = X.similarity_1d(pattern(grid, "click", 0, 24), grid, segments=4, alpha=4, k=60)
    return rounded(X.consolidate_matches(hits).select("signal_id", "start_index", "end_index", "distance"))


def track_grid(t):
    return search_space(tracks(t), START, END, 3 * HOUR, by=TRACK)


def track_patterns(grid, entity: str, names: list[str], length: int) -> dict[str, list[float]]:
    rows = grid.filter((F.col("entity_id") == entity) & F.col("track_id").isin(names) & (F.col("bin_idx") < length))
    out = {n: [] for n in names}
    for r in rows.orderBy("track_id", "bin_idx").select("track_id", "value").collect():
        out[r["track_id"]].append(r["value"])
    return out


@query("x04_similarity_multidim")
def _(t):
    grid = track_grid(t)
    hits = X.similarity_multidim(track_patterns(grid, "e0", ["click", "view"], 16), grid, 4, 4, per_track_k=10, max_delay=3)
    return rounded(hits.drop("track_matches"))


@query("x05_entity_tracks", sql_round("""WITH raw AS (SELECT 'n' || c_nationkey || '|' || c_mktsegment AS signal_id, ts, value FROM events JOIN customer ON c_custkey = user_id), """ + USER_FILLED.split(USERS + ",")[1] + " SELECT split_part(signal_id, '|', 1) AS entity_id, split_part(signal_id, '|', 2) AS track_id, bin_idx, ts, value FROM filled", "value"))
def _(t):
    dim = reading_dim(t)
    return rounded(X.entity_tracks(user_signals(t), dim.withColumnRenamed("entity", "level1"), dim, "level1", START, END, DAY))


@query("x06_similarity_mapped")
def _(t):
    grid = track_grid(t)
    names = t.events.select(F.col("event_type").alias("search_track")).distinct()
    mapping = names.withColumn("query_track", F.when(F.col("search_track") == "signup", "click").when(F.col("search_track") == "purchase", "view").otherwise(F.concat(F.lit("other-"), "search_track")))
    hits = X.similarity_mapped(track_patterns(grid, "e0", ["click", "view"], 16), grid, mapping, segments=4, alpha=4, per_track_k=10, max_delay=5)
    return rounded(hits.drop("track_matches"))


@query("x07_similarity_recurrence")
def _(t):
    grid = hourly(t)
    queries = {s: pattern(grid, s, 24, 24) for s in ("click", "view")}
    hits = X.similarity_recurrence(queries, grid, segments=4, alpha=4, per_track_k=40, max_delay=6)
    return rounded(hits.drop("track_matches"))


@query("x08_suggest_params", sql_round(f"""WITH {USERS}, q AS (SELECT signal_id AS query_id, count(*) AS n, stddev_pop(value) AS sd, max(value) - min(value) AS rg FROM raw GROUP BY signal_id),
c AS (SELECT *, CASE WHEN rg > 1e-9 THEN sd / rg ELSE 0 END AS cv FROM q)
SELECT query_id, least(32, n, greatest(least(4, n), floor(n / 4.0 + 0.5)))::INT AS segments, least(8, greatest(3, 4 + CASE WHEN n >= 48 AND cv >= 0.3 THEN CASE WHEN cv >= 0.4 THEN 2 ELSE 1 END WHEN n <= 12 OR sd <= 1e-9 THEN -1 ELSE 0 END))::INT AS alphabet_size,
 least(1e6, greatest(1e-6, sd * 0.03))::DOUBLE AS znorm_threshold, 0::INT AS symbol_tolerance FROM c""", "znorm_threshold"))
def _(t):
    return rounded(X.suggest_params(user_signals(t).withColumnRenamed("signal_id", "query_id")))


def sql_discords(pool: str, k: int, others: str = "true") -> str:
    """CTE ``dr``: the ``k`` farthest of the windows ``pool`` (a filter on ``cw``), non-overlapping within a signal."""
    greedy, last = sql_greedy("sc", "nn_distance DESC, start_index", 23, k, "start_index").rsplit("\nSELECT", 1)
    return recursive(FILLED + WINDOWS + f""", cw AS (SELECT *, count(*) OVER (PARTITION BY signal_id, word) AS word_frequency FROM sw),
cp AS (SELECT *, avg(word_frequency) OVER (PARTITION BY signal_id) AS cut FROM cw), cf AS (SELECT * FROM cp WHERE {pool}),
sc AS MATERIALIZED (SELECT c.signal_id, c.start_index, c.end_index, c.word, c.word_frequency, min(d) AS nn_distance, arg_min(j, (d, j)) AS nearest_neighbor_start
 FROM (SELECT c.*, w.start_index AS j, sqrt(pow(c.p0 - w.p0, 2) + pow(c.p1 - w.p1, 2) + pow(c.p2 - w.p2, 2) + pow(c.p3 - w.p3, 2)) AS d FROM cf c JOIN pw w ON c.signal_id = w.signal_id AND abs(c.start_index - w.start_index) >= 24 WHERE {others}) c GROUP BY ALL)"""
        + greedy + f""", dp AS (SELECT{last}), dr AS (SELECT * EXCLUDE (pick), (row_number() OVER (ORDER BY nn_distance DESC, signal_id, start_index))::INT AS rank FROM dp QUALIFY rank <= {k})""")


RAREST = "true QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY word_frequency, start_index) <= 60"


@query("x11_sax_discords", sql_round(sql_discords(RAREST, 10) + " SELECT * FROM dr", "nn_distance"))
def _(t):
    return rounded(X.sax_discords(hourly(t), 24, 10, 4, 4, candidates=60))


@query("x11_sax_discords_all", sql_round(sql_discords("word_frequency <= cut", 10) + " SELECT * FROM dr", "nn_distance"))
def _(t):
    return rounded(X.sax_discords(hourly(t), 24, 10, 4, 4, candidates=0))


@query("x12_discords_detection", sql_round(sql_discords("start_index >= 624 " + RAREST.removeprefix("true "), 5, "w.start_index < 624") + " SELECT * FROM dr", "nn_distance"))
def _(t):
    return rounded(X.sax_discords(hourly(t), 24, 5, 4, 4, candidates=60, detection_bins=96))


@query("x13_discord_thresholds", sql_round(sql_discords(RAREST, 20) + " SELECT quantile_cont(nn_distance, 0.5) AS p50, quantile_cont(nn_distance, 0.9) AS p90, quantile_cont(nn_distance, 0.95) AS p95, max(nn_distance) AS max, count(*) AS samples FROM dr", "p50 p90 p95 max"))
def _(t):
    return rounded(X.discord_thresholds(X.sax_discords(hourly(t), 24, 20, 4, 4, candidates=60)))


# ---------------------------------------------------------------- classification

TSEG = ", ".join(f"avg(value) OVER (o ROWS BETWEEN {4 * k} FOLLOWING AND {4 * k + 3} FOLLOWING) AS s{k}" for k in range(4))
BAGS = f""", wn AS (SELECT signal_id, bin_idx AS i, {TSEG}, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS c FROM filled
 WINDOW o AS (PARTITION BY signal_id ORDER BY bin_idx), w AS (PARTITION BY signal_id ORDER BY bin_idx ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
ww AS (SELECT signal_id, i, split_part(signal_id, '|', 2) AS class_label, {' || '.join(letter(f'((s{k} - m) / (CASE WHEN sd >= 0.01 THEN sd ELSE 1 END))') for k in range(4))} AS word FROM wn WHERE c = 16),
wr AS (SELECT * FROM ww QUALIFY lag(word) OVER (PARTITION BY signal_id ORDER BY i) IS DISTINCT FROM word),
bg AS (SELECT class_label, word, count(*) AS term_frequency FROM wr GROUP BY ALL),
df AS (SELECT word, count(DISTINCT class_label) AS document_frequency FROM bg GROUP BY word),
md AS (SELECT bg.*, document_frequency, (SELECT count(DISTINCT class_label) FROM bg) AS class_count, ln(1 + term_frequency) AS tf, ln((SELECT count(DISTINCT class_label) FROM bg) / document_frequency::DOUBLE) AS idf FROM bg JOIN df USING (word)),
mw AS (SELECT *, tf * idf AS weight FROM md),
ib AS (SELECT signal_id, word, count(*) AS n FROM wr GROUP BY ALL),
nr AS (SELECT signal_id, sqrt(sum(n * n)) AS l FROM ib GROUP BY signal_id), mn AS (SELECT class_label, sqrt(sum(weight * weight)) AS l FROM mw GROUP BY class_label),
dt AS (SELECT ib.signal_id, class_label, sum(weight * n) AS d FROM ib JOIN mw USING (word) GROUP BY ALL),
cs AS (SELECT nr.signal_id, mn.class_label, CASE WHEN mn.l * nr.l > 0 THEN coalesce(d, 0) / (mn.l * nr.l) ELSE 0 END AS s FROM nr CROSS JOIN mn LEFT JOIN dt ON dt.signal_id = nr.signal_id AND dt.class_label = mn.class_label)"""


def training(t):
    grid = track_grid(t)
    rows = grid.withColumn("class_label", F.col("track_id")).withColumn("series_id", F.concat_ws("|", "entity_id", "track_id"))
    return rows.select("class_label", "series_id", "bin_idx", "value")


def model(t):
    return X.vsm_train(X.vsm_wordbag(training(t), 16, 4, 4))


@query("x14_vsm_wordbag", TRACK_FILLED + BAGS + " SELECT * FROM bg")
def _(t):
    return X.vsm_wordbag(training(t), 16, 4, 4)


@query("x15_vsm_train", sql_round(TRACK_FILLED + BAGS + " SELECT * FROM mw", "tf idf weight"))
def _(t):
    return rounded(model(t))


@query("x16_vsm_scores", sql_round(TRACK_FILLED + BAGS + " SELECT signal_id AS series_id, class_label, s AS cosine_similarity, 1 - s AS cosine_distance FROM cs", "cosine_similarity cosine_distance"))
def _(t):
    return rounded(X.vsm_scores(model(t), training(t), 16, 4, 4))


@query("x16_vsm_classify", sql_round(TRACK_FILLED + BAGS + """ SELECT signal_id AS series_id, CASE WHEN count(*) FILTER (s >= b - 1e-12) > 1 THEN '' ELSE max(class_label) FILTER (s = b) END AS predicted_class, max(b) AS confidence, count(*) FILTER (s >= b - 1e-12) > 1 AS is_ambiguous
 FROM (SELECT *, max(s) OVER (PARTITION BY signal_id) AS b FROM cs) GROUP BY signal_id""", "confidence"))
def _(t):
    return rounded(X.vsm_classify(X.vsm_scores(model(t), training(t), 16, 4, 4)))


@query("x16_vsm_top_words", sql_round(TRACK_FILLED + BAGS + """ SELECT signal_id AS series_id, class_label, word, n AS input_tf, weight, weight * n AS contribution, (row_number() OVER (PARTITION BY signal_id, class_label ORDER BY round(weight * n, 9) DESC, word))::INT AS rank
 FROM ib JOIN mw USING (word) QUALIFY rank <= 3""", "weight contribution"))
def _(t):
    return rounded(X.vsm_top_words(model(t), training(t), 16, 4, 4, top=3))


SPANS = """, sp AS (SELECT CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS class_label, 'e' || event_id AS series_id, event_type AS signal_id, ts AS a, ts + INTERVAL 12 HOUR AS z FROM events WHERE value > 100 OR value < 2),
hb AS (SELECT class_label, series_id, (epoch_us(r.ts) - epoch_us(a)) // 7200000000 AS b, avg(r.value) AS v FROM sp JOIN raw r ON r.signal_id = sp.signal_id AND r.ts BETWEEN a AND z GROUP BY ALL),
fr AS (SELECT class_label, series_id, i.i AS bin_idx, hb.v AS value FROM sp CROSS JOIN range(6) i(i) LEFT JOIN hb USING (class_label, series_id) WHERE hb.b = i.i OR hb.b IS NULL),
gd AS (SELECT sp.class_label, sp.series_id, i.i AS bin_idx FROM sp CROSS JOIN range(6) i(i)),
gv AS (SELECT gd.*, hb.v AS value FROM gd LEFT JOIN hb ON hb.class_label = gd.class_label AND hb.series_id = gd.series_id AND hb.b = gd.bin_idx)"""


@query("x17_vsm_training", sql_round(f"WITH {SIGNALS}" + SPANS + """, nz AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN bin_idx END IGNORE NULLS) OVER p AS pi, last_value(value IGNORE NULLS) OVER p AS pv, first_value(CASE WHEN value IS NOT NULL THEN bin_idx END IGNORE NULLS) OVER f AS ni, first_value(value IGNORE NULLS) OVER f AS nv FROM gv
 WINDOW p AS (PARTITION BY series_id ORDER BY bin_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY series_id ORDER BY bin_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT class_label, series_id, bin_idx, CASE WHEN value IS NOT NULL THEN value WHEN pi IS NULL THEN nv WHEN ni IS NULL THEN pv ELSE pv + (nv - pv) * (bin_idx - pi) / (ni - pi)::DOUBLE END AS value FROM nz""", "value"))
def _(t):
    ev = t.events.filter((F.col("value") > 100) | (F.col("value") < 2))
    spans = ev.select(
        F.when(F.col("value") > 100, "high").otherwise("low").alias("class_label"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("series_id"),
        F.col("event_type").alias("signal_id"), F.col("ts").alias("start_ts"),
        (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("end_ts"),
    )
    return rounded(X.vsm_training(spans, signals(t), 2 * HOUR))


# ---------------------------------------------------------------- cycles

CYCLES = "raw AS (SELECT event_type || '|' || ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 86400000000) AS signal_id, TIMESTAMP '2024-01-01' + to_microseconds((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) % 86400000000) AS ts, value FROM events)"
from signalmill.plans.samples import sql_grid  # noqa: E402

CYCLE_FILLED = sql_grid(CYCLES, "3H", 8)


def cycles(t):
    return X.extract_cycles(signals(t), START, END, DAY, 3 * HOUR)


@query("x18_extract_cycles", sql_round(CYCLE_FILLED + " SELECT split_part(signal_id, '|', 1) AS signal_id, split_part(signal_id, '|', 2)::BIGINT AS cycle, bin_idx, value FROM filled", "value"))
def _(t):
    return rounded(cycles(t))


CUTS = ("-0.67", "0", "0.67")
CYCLE_WORDS = f""", cz AS (SELECT *, avg(value) OVER s AS m, stddev_pop(value) OVER s AS sd FROM filled WINDOW s AS (PARTITION BY signal_id)),
cp AS (SELECT signal_id, bin_idx // 2 AS seg, avg(CASE WHEN sd < 0.001 THEN 0 ELSE (value - m) / sd END) AS v FROM cz GROUP BY ALL),
cw AS (SELECT split_part(signal_id, '|', 1) AS signal_id, split_part(signal_id, '|', 2)::BIGINT AS cycle, string_agg({letter('v', CUTS)}, '' ORDER BY seg) AS word FROM cp GROUP BY ALL)"""


@query("x19_cycle_words", CYCLE_FILLED + CYCLE_WORDS + " SELECT * FROM cw")
def _(t):
    return X.cycle_words(cycles(t), 4, 4).select("signal_id", "cycle", "word")


@query("x19_cycle_distances", sql_round(CYCLE_FILLED + CYCLE_WORDS + """, gp AS (SELECT a.signal_id, a.cycle AS cycle_a, b.cycle AS cycle_b, ascii(substr(a.word, p.p::INT, 1)) - 97 AS ca, ascii(substr(b.word, p.p::INT, 1)) - 97 AS cb FROM cw a JOIN cw b ON a.signal_id = b.signal_id AND a.cycle < b.cycle CROSS JOIN range(1, 5) p(p))
""" + _mindist_sql("gp", "signal_id, cycle_a, cycle_b", 4, 8), "distance"))
def _(t):
    return rounded(X.cycle_distances(X.cycle_words(cycles(t), 4, 4), 4, 8))


@query("x19_nearest_cycles", sql_round(CYCLE_FILLED + CYCLE_WORDS + """, gp AS (SELECT a.signal_id, a.cycle AS cycle_a, b.cycle AS cycle_b, ascii(substr(a.word, p.p::INT, 1)) - 97 AS ca, ascii(substr(b.word, p.p::INT, 1)) - 97 AS cb FROM cw a JOIN cw b ON
 a.signal_id = b.signal_id AND a.cycle <> b.cycle CROSS JOIN range(1, 5) p(p)), md AS (""" + _mindist_sql("gp", "signal_id, cycle_a, cycle_b", 4, 8) + """),
rk AS (SELECT signal_id, cycle_a AS cycle, row_number() OVER (PARTITION BY signal_id, cycle_a ORDER BY round(distance, 9), cycle_b)::INT AS rank, cycle_b AS neighbour, distance FROM md) SELECT * FROM rk WHERE rank <= 3""", "distance"))
def _(t):
    return rounded(X.nearest_cycles(X.cycle_words(cycles(t), 4, 4), 4, 8, 3))


@query("x20_cluster_cycles")
def _(t):
    return X.cluster_cycles(X.cycle_words(cycles(t), 4, 4), 3, 4, 8)


@query("x21_linkage")
def _(t):
    return rounded(X.linkage(X.cycle_words(cycles(t), 4, 4), 4, 8))
