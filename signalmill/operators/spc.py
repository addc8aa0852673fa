"""Control charts, special-cause rules and process capability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from signalmill.functions.normal import normal_cdf
from signalmill.functions.ordered import BLOCK, attach, framed, ordinal
from signalmill.functions.timeparts import DAY, floor_div, to_us
from signalmill.operators.catalog import best_row
from signalmill.plans.runtime import checkpointed

SIGNAL = ("signal_id",)
CHARTS = ("i-mr", "xbar-r", "xbar-s")
# Control-chart constants by subgroup size, columns d2 A2 A3 B3 B4 D3 D4.
CONSTANTS = {
    2: (1.128, 1.88, 2.659, 0, 3.267, 0, 3.267),
    3: (1.693, 1.023, 1.954, 0, 2.568, 0, 2.574),
    4: (2.059, 0.729, 1.628, 0, 2.266, 0, 2.282),
    5: (2.326, 0.577, 1.427, 0, 2.089, 0, 2.114),
    6: (2.534, 0.483, 1.287, 0.03, 1.97, 0, 2.004),
    7: (2.704, 0.419, 1.182, 0.118, 1.882, 0.076, 1.924),
    8: (2.847, 0.373, 1.099, 0.185, 1.815, 0.136, 1.864),
    9: (2.97, 0.337, 1.032, 0.239, 1.761, 0.184, 1.816),
    10: (3.078, 0.308, 0.975, 0.284, 1.716, 0.223, 1.777),
    11: (3.173, 0.285, 0.927, 0.321, 1.679, 0.256, 1.744),
    12: (3.258, 0.266, 0.886, 0.354, 1.646, 0.283, 1.717),
    13: (3.336, 0.249, 0.85, 0.382, 1.618, 0.307, 1.693),
    14: (3.407, 0.235, 0.817, 0.406, 1.594, 0.328, 1.672),
    15: (3.472, 0.223, 0.789, 0.428, 1.572, 0.347, 1.653),
    16: (3.532, 0.212, 0.763, 0.448, 1.552, 0.363, 1.637),
    17: (3.588, 0.203, 0.739, 0.466, 1.534, 0.378, 1.622),
    18: (3.64, 0.194, 0.718, 0.482, 1.518, 0.391, 1.608),
    19: (3.689, 0.187, 0.698, 0.497, 1.503, 0.403, 1.597),
    20: (3.735, 0.18, 0.68, 0.51, 1.49, 0.415, 1.585),
    21: (3.778, 0.173, 0.663, 0.523, 1.477, 0.425, 1.575),
    22: (3.819, 0.167, 0.647, 0.534, 1.466, 0.434, 1.566),
    23: (3.858, 0.162, 0.633, 0.545, 1.455, 0.443, 1.557),
    24: (3.895, 0.157, 0.619, 0.555, 1.445, 0.451, 1.548),
    25: (3.931, 0.153, 0.606, 0.565, 1.435, 0.459, 1.541),
}
NAMES = ("d2", "A2", "A3", "B3", "B4", "D3", "D4")
# Run lengths of the rules and the rule sets of each profile.
RUNS = {"same_side": 9, "trend": 6, "alternating": 14, "within_1": 15, "beyond_1": 8}
PROFILES = {
    "basic": ((1,), {}),
    "weco": ((1, 5, 6, 2), {"same_side": 8}),
    "nelson": ((1, 2, 3, 4, 5, 6, 7, 8), {}),
    "minitab": ((1, 2, 3, 4, 5, 6, 7, 8), {}),
}


def subgroups(
    df: DataFrame,
    n: int,
    by: Sequence[str] = SIGNAL,
    order: Sequence[Column | str] = ("ts",),
    bucket: Column | None = None,
) -> DataFrame:
    """Groups of ``n`` consecutive readings, stamped with their last time.

    A trailing partial group stays when it has two readings or more (``n`` 1 keeps all).
    """
    by = list(by)
    rows = df.filter(F.col("value").isNotNull())
    slot = floor_div(to_us("ts"), DAY) if bucket is None else bucket
    rows = ordinal(rows, by, order, slot, name="_at").withColumn("subgroup", floor_div(F.col("_at"), int(n)))
    out = rows.groupBy(*by, "subgroup").agg(
        F.max("ts").alias("ts"),
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        (F.max("value") - F.min("value")).alias("range"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev"),
    )
    return out if n == 1 else out.filter(F.col("n") >= 2)


def _constant(name: str, n: Column) -> Column:
    at = NAMES.index(name)
    table = F.create_map(*[F.lit(v) for size, row in CONSTANTS.items() for v in (size, float(row[at]))])
    return F.element_at(table, F.least(F.greatest(n, F.lit(2)), F.lit(25)).cast("int"))


def chart_points(sub: DataFrame, chart: str, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Plotted statistic and its variation (moving range, range or deviation) per subgroup."""
    if chart not in CHARTS:
        raise ValueError(f"chart must be one of {CHARTS}")
    by = list(by)
    if chart == "i-mr":
        out = framed(sub, by, {"_p": lambda w: F.lag("mean").over(w)}, before=1, idx="subgroup")
        variation = F.abs(F.col("mean") - F.col("_p"))
    else:
        out, variation = sub, F.col("range" if chart == "xbar-r" else "stdev")
    return out.select(*by, "subgroup", "ts", F.col("mean").alias("value"), variation.alias("variation"), "n")


def control_limits(sub: DataFrame, chart: str, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Centre, sigma and limits of the plotted statistic and of its variation."""
    by = list(by)
    facts = chart_points(sub, chart, by).groupBy(*by).agg(
        F.avg("value").alias("center"),
        F.coalesce(F.avg("variation"), F.lit(0.0)).alias("s_center"),
        F.min_by("n", "subgroup").alias("subgroup_size"),
        F.count(F.lit(1)).alias("n_subgroups"),
    )
    size = F.lit(2) if chart == "i-mr" else F.col("subgroup_size")
    low, high = ("D3", "D4") if chart != "xbar-s" else ("B3", "B4")
    if chart == "i-mr":
        sigma = F.col("s_center") / _constant("d2", size)
    else:
        sigma = _constant("A2" if chart == "xbar-r" else "A3", size) * F.col("s_center") / 3
    return facts.select(
        *by,
        F.lit(chart).alias("chart"),
        (F.lit(1) if chart == "i-mr" else F.col("subgroup_size")).cast("bigint").alias("subgroup_size"),
        "n_subgroups",
        "center",
        sigma.alias("sigma"),
        (F.col("center") + 3 * sigma).alias("ucl"),
        (F.col("center") - 3 * sigma).alias("lcl"),
        "s_center",
        (_constant(high, size) * F.col("s_center")).alias("s_ucl"),
        (_constant(low, size) * F.col("s_center")).alias("s_lcl"),
    )


LIMITS = ("center", "sigma", "ucl", "lcl", "s_center", "s_ucl", "s_lcl")


def control_chart(sub: DataFrame, chart: str, frozen: DataFrame | None = None, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Points with their limits and zone: own limits (phase I) or a frozen table (phase II)."""
    by = list(by)
    if frozen is None:
        sub = checkpointed(sub)  # read for the limits and for the points
    limits = control_limits(sub, chart, by) if frozen is None else frozen
    out = attach(chart_points(sub, chart, by), limits.select(*by, *LIMITS), by, salt="subgroup")
    return out.withColumn("phase", F.lit("I" if frozen is None else "II")).withColumn("zone", _zone(F.col("value")))


def _zone(v: Column) -> Column:
    """Signed distance from the centre in sigmas (infinite off-centre when sigma is 0)."""
    side = F.when(v > F.col("center"), float("inf")).when(v < F.col("center"), float("-inf")).otherwise(0.0)
    return F.when(F.col("sigma") > 0, (v - F.col("center")) / F.col("sigma")).otherwise(side)


def run_rules(
    points: DataFrame, profile: str = "nelson", by: Sequence[str] = SIGNAL, idx: str = "subgroup", runs: dict | None = None, block: int = BLOCK
) -> DataFrame:
    """Special-cause violations: one row per flagged point and rule.

    ``points`` has ``idx``, ``value`` and the limits (see ``control_chart``). Points without
    a value are passed over: the others count as consecutive.
    """
    by = list(by)
    rules, changed = PROFILES[profile]
    run = {**RUNS, **changed, **(runs or {})}
    z, v = F.col("_z"), F.col("value")
    rows = points.filter(v.isNotNull()).withColumn("_z", _zone(v))
    rows = ordinal(rows, by, [idx], floor_div(F.col(idx), BLOCK), name="_nth")
    rows = rows.withColumn("_side", F.signum(v - F.col("center")))
    trailing = lambda w, n: w.rowsBetween(-(n - 1), 0)
    hits = lambda cond, w, n: F.sum(F.when(cond, 1).otherwise(0)).over(trailing(w, n))
    step = F.col("_step")
    cols = {
        "_step": lambda w: F.signum(v - F.lag(v).over(w)),
        "_alt": lambda w: (F.col("_step") != 0) & (F.col("_step") == -F.lag("_step").over(w)),
        "_above": lambda w: hits(F.col("_side") > 0, w, run["same_side"]),
        "_below": lambda w: hits(F.col("_side") < 0, w, run["same_side"]),
        "_up": lambda w: hits(step > 0, w, run["trend"] - 1),
        "_down": lambda w: hits(step < 0, w, run["trend"] - 1),
        "_turns": lambda w: hits(F.col("_alt"), w, run["alternating"] - 2),
        "_hi2": lambda w: hits(z >= 2, w, 3),
        "_lo2": lambda w: hits(z <= -2, w, 3),
        "_hi1": lambda w: hits(z >= 1, w, 5),
        "_lo1": lambda w: hits(z <= -1, w, 5),
        "_n": lambda w: F.count(F.lit(1)).over(trailing(w, 5)),
        "_in1": lambda w: hits(F.abs("_z") < 1, w, run["within_1"]),
        "_out1": lambda w: hits(F.abs("_z") > 1, w, run["beyond_1"]),
    }
    rows = framed(rows, by, cols, before=max(run.values()) + 2, idx="_nth", block=block)
    c = F.col
    found = {
        1: F.when(v > c("ucl"), "above").when(v < c("lcl"), "below"),
        2: F.when(c("_above") >= run["same_side"], "above").when(c("_below") >= run["same_side"], "below"),
        3: F.when(c("_up") >= run["trend"] - 1, "above").when(c("_down") >= run["trend"] - 1, "below"),
        4: F.when(c("_turns") >= run["alternating"] - 2, "both"),
        5: F.when(c("_n") >= 3, F.when((c("_hi2") >= 2) & (z >= 2), "above").when((c("_lo2") >= 2) & (z <= -2), "below")),
        6: F.when(c("_n") >= 5, F.when((c("_hi1") >= 4) & (z >= 1), "above").when((c("_lo1") >= 4) & (z <= -1), "below")),
        7: F.when(c("_in1") >= run["within_1"], "both"),
        8: F.when(c("_out1") >= run["beyond_1"], "both"),
    }
    rows = rows.withColumn("_f", F.array(*[F.struct(F.lit(i).alias("rule_id"), found[i].alias("side")) for i in sorted(rules)]))
    rows = rows.withColumn("_f", F.explode(F.filter("_f", lambda f: f["side"].isNotNull())))
    return rows.select(*by, idx, "ts", "value", "_f.rule_id", "_f.side")


def observed_run_length(points: DataFrame, profile: str = "nelson", by: Sequence[str] = SIGNAL, idx: str = "subgroup") -> DataFrame:
    """Mean number of points up to the first signal over a table of in-control series.

    A series without a signal counts with its full length.
    """
    by = list(by)
    first = run_rules(points, profile, by, idx).groupBy(*by).agg((F.min(idx) + 1).alias("_first"))
    length = points.groupBy(*by).agg((F.max(idx) + 1).alias("_len"))
    each = length.join(first, by, "left")
    return each.agg(
        F.count(F.lit(1)).alias("series"),
        F.count("_first").alias("signalled"),
        F.avg(F.coalesce("_first", "_len")).alias("mean_run_length"),
    ).withColumn("alpha", F.when(F.col("mean_run_length") > 0, 1 / F.col("mean_run_length")).otherwise(0.0))


def baseline_sufficiency(sub: DataFrame, warn_below: int = 20, recommend: int = 25, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Whether the estimating window has enough subgroups."""
    counts = sub.groupBy(*by).agg(F.count(F.lit(1)).alias("subgroups"))
    grade = F.when(F.col("subgroups") >= recommend, "good").when(F.col("subgroups") >= warn_below, "thin").otherwise("insufficient")
    return counts.withColumn("sufficient", F.col("subgroups") >= warn_below).withColumn("grade", grade)


def within_sigma(limits: DataFrame) -> Column:
    """Process sigma from the sigma of the plotted mean."""
    return F.col("sigma") * F.sqrt(F.greatest(F.col("subgroup_size"), F.lit(1)))


def capability(
    df: DataFrame, specs: DataFrame, by: Sequence[str] = SIGNAL, exploratory: bool = False, warn_below: int = 20
) -> DataFrame:
    """Capability and performance indices per signal.

    ``specs`` has ``lsl, usl, target, sigma_w, in_control`` per key (any may be NULL).
    """
    by = list(by)
    spec_cols = ["lsl", "usl", "target", "sigma_w", "in_control"]
    rows = attach(df.filter(F.col("value").isNotNull()), specs.select(*by, *spec_cols), by, salt="value")
    outside = (F.col("value") < F.col("lsl")) | (F.col("value") > F.col("usl"))
    facts = rows.groupBy(*by, *spec_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sigma"),
        F.count_if(outside).alias("_out"),
    ).filter(F.col("n") >= 2)
    m, lsl, usl, target = (F.col(c) for c in ("mean", "lsl", "usl", "target"))
    sw = F.when(F.col("sigma_w") > 0, F.col("sigma_w"))
    so = F.when(F.col("sigma") > 0, F.col("sigma"))
    tau = F.sqrt(F.col("sigma") * F.col("sigma") + (m - target) * (m - target))

    def ppm(sd: Column, low: bool) -> Column:
        p = normal_cdf((lsl - m) / sd) if low else 1 - normal_cdf((usl - m) / sd)
        flat = F.when(m < lsl, 1e6).otherwise(0.0) if low else F.when(m > usl, 1e6).otherwise(0.0)
        inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)) * 1e6
        return F.when((lsl if low else usl).isNotNull(), F.when(sd.isNotNull(), inside).otherwise(flat))

    stable = F.coalesce("in_control", F.lit(False))
    warnings = F.array_compact(
        F.array(
            F.when(~stable, "not_in_control"),
            F.when(F.col("n") < warn_below, "few_observations"),
            F.when(lsl.isNull() | usl.isNull(), "one_sided"),
            F.when(F.col("sigma_w").isNull(), "no_within_sigma"),
        )
    )
    return facts.select(
        *by,
        "n",
        "mean",
        "sigma",
        ((usl - lsl) / (6 * sw)).alias("cp"),
        ((usl - m) / (3 * sw)).alias("cpu"),
        ((m - lsl) / (3 * sw)).alias("cpl"),
        F.least((usl - m) / (3 * sw), (m - lsl) / (3 * sw)).alias("cpk"),
        ((usl - lsl) / (6 * so)).alias("pp"),
        ((usl - m) / (3 * so)).alias("ppu"),
        ((m - lsl) / (3 * so)).alias("ppl"),
        F.least((usl - m) / (3 * so), (m - lsl) / (3 * so)).alias("ppk"),
        F.when(so.isNotNull() & (tau > 0), (usl - lsl) / (6 * tau)).alias("cpm"),
        ppm(so, True).alias("ppm_below"),
        ppm(so, False).alias("ppm_above"),
        (F.coalesce(ppm(so, True), F.lit(0.0)) + F.coalesce(ppm(so, False), F.lit(0.0))).alias("ppm_total"),
        F.when(sw.isNotNull(), F.coalesce(ppm(sw, True), F.lit(0.0)) + F.coalesce(ppm(sw, False), F.lit(0.0))).alias("ppm_potential"),
        (F.col("_out") / F.col("n") * 1e6).alias("ppm_observed"),
        (stable | F.lit(exploratory)).alias("allowed"),
        F.array_join(warnings, ",").alias("warnings"),
    )


# ---- governed baselines: an append-only log, the last entry per baseline and version counts

LOG = ("baseline_id", "version", "parent_version", "status", "action", "by", "at", "seq")


def save_baseline(limits: DataFrame, name: Column, by_user: str, at: Column) -> DataFrame:
    """Draft entries (version 1) for a table of limits."""
    return limits.select(
        name.alias("baseline_id"),
        F.lit(1).alias("version"),
        F.lit(None).cast("int").alias("parent_version"),
        F.lit("draft").alias("status"),
        F.lit("CREATED").alias("action"),
        F.lit(by_user).alias("by"),
        at.alias("at"),
        F.lit(1).alias("seq"),
        *limits.columns,
    )


def current_baselines(log: DataFrame) -> DataFrame:
    """Latest entry of every version."""
    return best_row(log, ["baseline_id", "version"], [F.col("seq").desc()])


def _step(log: DataFrame, ids: DataFrame, status: str, action: str, by_user: str, at: Column, only: str | None) -> DataFrame:
    now = current_baselines(log).join(ids.select("baseline_id", "version").distinct(), ["baseline_id", "version"], "left_semi")
    if only is not None:
        now = now.filter(F.col("status") == only)
    entry = (
        now.withColumn("status", F.lit(status))
        .withColumn("action", F.lit(action))
        .withColumn("by", F.lit(by_user))
        .withColumn("at", at)
        .withColumn("seq", F.col("seq") + 1)
    )
    return log.unionByName(entry)


def approve(log: DataFrame, ids: DataFrame, by_user: str, at: Column) -> DataFrame:
    """Freeze drafts; entries that are not drafts are left alone."""
    return _step(log, ids, "approved", "APPROVED", by_user, at, only="draft")


def retire(log: DataFrame, ids: DataFrame, by_user: str, at: Column) -> DataFrame:
    """Withdraw versions from monitoring."""
    return _step(log, ids, "retired", "RETIRED", by_user, at, only=None)


def revise(log: DataFrame, limits: DataFrame, by_user: str, at: Column) -> DataFrame:
    """New draft versions from fresh limits (``baseline_id`` plus limit columns)."""
    top = log.groupBy("baseline_id").agg(F.max("version").alias("_v"))
    fresh = limits.join(top, "baseline_id")
    entry = fresh.select(
        "baseline_id",
        (F.col("_v") + 1).alias("version"),
        F.col("_v").alias("parent_version"),
        F.lit("draft").alias("status"),
        F.lit("REVISED").alias("action"),
        F.lit(by_user).alias("by"),
        at.alias("at"),
        F.lit(1).alias("seq"),
        *[c for c in limits.columns if c != "baseline_id"],
    )
    return log.unionByName(entry)


def effective_baselines(log: DataFrame) -> DataFrame:
    """The highest approved version of each baseline: the frozen limits for phase II."""
    live = current_baselines(log).filter(F.col("status") == "approved")
    return best_row(live, ["baseline_id"], [F.col("version").desc()])
