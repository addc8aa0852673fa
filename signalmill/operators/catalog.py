"""Signal catalog: hierarchy and metadata joins, search, facets, governed limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Canonical catalog columns.
TEXT_COLUMNS = (
    ["signal_name", "metric", "unit", "sampling_frequency", "description"]
    + [f"level{i}" for i in range(1, 11)]
    + ["active_baseline_id", "preferred_chart_type", "rule_profile"]
)
NUMBER_COLUMNS = [
    "operating_setpoint",
    "upper_operating_limit",
    "lower_operating_limit",
    "max_rate_of_change",
    "usl",
    "lsl",
    "target",
    "physical_min",
    "physical_max",
    "sensor_uncertainty",
    "recommended_alert_threshold",
    "recommended_confidence",
]
SEARCHED = ("signal_name", "signal_id", "metric", "description")


def catalog(hierarchy: DataFrame, metadata: DataFrame) -> DataFrame:
    """Hierarchy left-joined to metadata; missing optional columns get defaults."""
    extra = [c for c in metadata.columns if c not in hierarchy.columns]
    joined = hierarchy.join(metadata.select("signal_id", *extra), "signal_id", "left")
    have = set(joined.columns)
    cols: list[Column] = [F.col("signal_id")]
    cols += [(F.col(c) if c in have else F.lit("")).alias(c) for c in TEXT_COLUMNS]
    cols += [(F.col(c).cast("double") if c in have else F.lit(None).cast("double")).alias(c) for c in NUMBER_COLUMNS]
    return joined.select(*cols)


def search(cat: DataFrame, text: str) -> DataFrame:
    """Every word of ``text`` must occur, ignoring case, in one of the searched columns."""
    for word in text.split():
        hit = F.lit(False)
        for name in SEARCHED:
            hit = hit | F.coalesce(F.contains(F.lower(name), F.lit(word.lower())), F.lit(False))
        cat = cat.filter(hit)
    return cat


def filter_catalog(
    cat: DataFrame,
    scope: dict[str, str] | None = None,
    facets: dict[str, Sequence[str]] | None = None,
    text: str = "",
) -> DataFrame:
    """Scope equality, facet membership (or within, and across) and free text."""
    for name, val in (scope or {}).items():
        if val and val.strip():
            cat = cat.filter(F.col(name) == val.strip())
    for name, vals in (facets or {}).items():
        vals = [v for v in vals if v and v.strip()]
        if vals:
            cat = cat.filter(F.col(name).isin(vals))
    return search(cat, text)


def page(cat: DataFrame, skip: int = 0, take: int = 100, order: Sequence[str] = ("signal_name", "signal_id")) -> DataFrame:
    """One ordered page with one extra row that tells the caller there is more."""
    return cat.orderBy(*order).offset(max(0, int(skip))).limit(max(int(take), 1) + 1)


def count_tags(cat: DataFrame) -> DataFrame:
    return cat.agg(F.count(F.lit(1)).alias("count"))


def children(cat: DataFrame, level: str, scope: dict[str, str] | None = None) -> DataFrame:
    """Distinct values of one hierarchy level below a scope, with signal counts."""
    return _value_counts(filter_catalog(cat, scope), level)


def facet_values(cat: DataFrame, facet: str, prefix: str = "", **filters) -> DataFrame:
    """Distinct facet values containing the typed text, with signal counts."""
    rows = filter_catalog(cat, **filters)
    if prefix.strip():
        rows = rows.filter(F.contains(F.lower(facet), F.lit(prefix.strip().lower())))
    return _value_counts(rows, facet)


def _value_counts(rows: DataFrame, name: str) -> DataFrame:
    some = F.coalesce(F.col(name), F.lit("")) != ""
    return rows.filter(some).groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def overlay_metadata(cat: DataFrame, governed: DataFrame) -> DataFrame:
    """Governed values replace catalog values wherever they are set."""
    shared = [c for c in governed.columns if c != "signal_id" and c in cat.columns]
    right = governed.select("signal_id", *[F.col(c).alias(f"_g_{c}") for c in shared])
    out = cat.join(right, "signal_id", "left")
    return out.select(*[F.coalesce(f"_g_{c}", c).alias(c) if c in shared else F.col(c) for c in cat.columns])


def effective_metadata(rows: DataFrame, scope_key: str | None = None, prefer_approved: bool = False) -> DataFrame:
    """The governed row in force per signal: not retired, then the highest version.

    ``prefer_approved`` ranks approved rows before drafts, whatever their version.
    """
    live = rows.filter(F.col("status") != "retired")
    if scope_key is not None:
        live = live.filter(F.col("scope_key") == scope_key)
    rank = [F.col("version").desc()]
    if prefer_approved:
        rank.insert(0, (F.col("status") == "approved").desc())
    return best_row(live, ["signal_id"], rank)


def best_row(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key under the ordering."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def limit_defaults(cat: DataFrame) -> DataFrame:
    """Alert threshold and direction, risk limits and plausible range from governed limits."""
    upper, lower = F.coalesce("usl", "upper_operating_limit"), F.coalesce("lsl", "lower_operating_limit")
    slack = F.coalesce("sensor_uncertainty", F.lit(0.0))
    return cat.select(
        "signal_id",
        F.coalesce("recommended_alert_threshold", upper, lower).alias("threshold"),
        F.when(upper.isNotNull(), "above").when(lower.isNotNull(), "below").alias("direction"),
        F.coalesce("upper_operating_limit", "usl").alias("upper_limit"),
        F.coalesce("lower_operating_limit", "lsl").alias("lower_limit"),
        (F.col("physical_min") - slack).alias("plausible_min"),
        (F.col("physical_max") + slack).alias("plausible_max"),
        F.col("max_rate_of_change").alias("rate_per_minute"),
        F.col("recommended_confidence").alias("confidence"),
    )


def filter_labels(
    labels: DataFrame,
    kind: str | None = None,
    category: str | None = None,
    signal: str | None = None,
    analysis_type: str | None = None,
    text: str = "",
) -> DataFrame:
    """Saved patterns by kind, category, signal, analysis type and substring."""
    for name, val in (("kind", kind), ("category", category), ("signal_id", signal), ("analysis_type", analysis_type)):
        if val is not None:
            labels = labels.filter(F.col(name) == val)
    needle = text.strip().lower()
    if needle:
        hay = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("name", "category", "signal_id", "signal_name", "job_id")])
        labels = labels.filter(F.contains(F.lower(hay), F.lit(needle)))
    return labels


def sort_labels(labels: DataFrame, key: str = "created_at", descending: bool = True) -> DataFrame:
    first = F.col(key).desc() if descending else F.col(key).asc()
    return labels.orderBy(first, "label_id")


def label_facets(labels: DataFrame) -> DataFrame:
    """Distinct categories, signals and analysis types of the saved patterns."""
    facets = F.array(
        *[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in ("category", "signal_id", "analysis_type")]
    )
    rows = labels.select(F.explode(facets).alias("f")).select("f.*")
    return rows.filter(F.coalesce("value", F.lit("")) != "").distinct()
