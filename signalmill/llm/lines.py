"""Line dedup by distinct-site spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from signalmill.llm.names import unused
from signalmill.plans.runtime import written

SITES = 10  # a line on at least so many sites is boilerplate
LOG_REGISTERS = 12  # of a sketch; its relative standard error is about 1.04 / 2^(LOG_REGISTERS / 2)
ERRORS = 5  # standard errors around the threshold within which sites are counted exactly
BLANK = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of a line without the white space around it."""
    body = F.btrim(line, F.lit(BLANK))
    return F.struct(F.xxhash64(body).alias("h1"), F.xxhash64(F.concat(body, F.lit("\n"))).alias("h2"))


def widespread(docs: DataFrame, sites: int = SITES, site: str = "source") -> DataFrame:
    """(h1, h2, doc, pos): the keys of lines found on at least ``sites`` sites, and where each comes first.

    One HyperLogLog sketch of sites per line hash is built in each task and merged by aggregation.
    Lines whose estimate is near the threshold get their distinct sites counted, so the decision
    does not hang on the sketch's error. Blank lines do not count; a null site is a site of its own.
    """
    lines = docs.filter("text is not null").select(F.col("doc_id").cast("bigint").alias("doc"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.filter(F.btrim("line", F.lit(BLANK)) != "").select("doc", "site", "pos", _key(F.col("line")).alias("h")).select("doc", "site", "pos", "h.*")
    band = max(1.0, ERRORS * 1.04 / 2 ** (LOG_REGISTERS / 2) * sites)
    sketch = F.hll_sketch_agg("site", LOG_REGISTERS)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(sketch).alias("about"), F.min(F.struct(F.col("doc").isNull(), "doc", "pos")).alias("first"))
    spread, _ = written(spread.filter(F.col("about") >= sites - band).select("h1", "h2", "about", "first.doc", "first.pos"))
    open_ = spread.filter(F.col("about") <= sites + band)
    exact = lines.join(open_.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("exact")).filter(F.col("exact") >= sites).drop("exact")
    sure = spread.filter(F.col("about") > sites + band)
    return sure.unionByName(open_.join(exact, ["h1", "h2"])).drop("about")


def drop_widespread(docs: DataFrame, sites: int = SITES, site: str = "source") -> DataFrame:
    """``docs`` without the repeats of widespread lines; the line stays where it comes first (smallest doc_id, then place).

    All rows stay, a text may become empty, a null text stays null. Texts without such lines are
    unchanged, and ``n_chars``, where there is one, counts the new text. Rows without a doc_id come
    last and lose every widespread line that stands elsewhere. Other columns pass through.
    """
    found, _ = written(widespread(docs, sites, site))
    spots = docs.filter("text is not null").select(F.col("doc_id").cast("bigint").alias("_id"), F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _key))).alias("h")).select("_id", "h.*")
    hits = spots.join(found, ["h1", "h2"]).select("_id", F.struct("h1", "h2", F.when(F.col("doc").eqNullSafe(F.col("_id")), F.col("pos")).otherwise(-1).alias("stay")).alias("hit"))
    one, many = unused(docs, "_id"), unused(docs, "_drop")
    drops = hits.groupBy(F.col("_id").alias(one)).agg(F.collect_set("hit").alias(many))
    kept = F.filter(_lines(F.col("text")), lambda x, i: ~F.exists(many, lambda d: (d.h1 == _key(x).h1) & (d.h2 == _key(x).h2) & (d.stay != i)))
    out = docs.join(drops, docs["doc_id"].eqNullSafe(drops[one]), "left").drop(one)
    out = out.withColumn("text", F.when(F.col(many).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop(many)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), F.lit(0).cast("bigint"))) if "n_chars" in docs.columns else out


def op6(docs: DataFrame) -> DataFrame:
    """The query: each document's new text."""
    return drop_widespread(docs).select("doc_id", "text", "n_chars")


OP6_SQL = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS body FROM l),
b AS (SELECT body, min((doc_id, pos)) AS first FROM k WHERE body <> '' GROUP BY body HAVING count(DISTINCT site) >= {SITES}),
t AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.body IS NULL OR (doc_id, pos) = first), '') AS text
  FROM k LEFT JOIN b USING (body) GROUP BY doc_id)
SELECT d.doc_id, t.text, coalesce(length(t.text), 0) AS n_chars FROM documents d LEFT JOIN t USING (doc_id)
"""
