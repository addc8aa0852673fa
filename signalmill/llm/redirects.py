"""URL filters with redirect equivalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from signalmill.llm.components import connected

#: (host, path prefix, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAG = r"(?is)<(?:link|meta)\b[^<>]*>"
REL = r"""(?<![\w-])rel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?=[\s/>]))"""
CANONICAL = rf"(?is)^<link\b(?=[^>]*{REL})[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)^<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def decide(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict; nulls where none fits.

    A rule fits its host and all subdomains where the path starts with the rule's. Longest counts
    the characters of host and path. The rules are a fixed short list, so they become one CASE.
    """
    name = verdict = None
    for rule_host, rule_path, word in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, word) if verdict is None else verdict.when(fits, word)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _without_dots(path: Column) -> Column:
    """A path that starts with ``/``, its ``.`` and ``..`` segments worked off."""
    parts = F.slice(F.split(path, "/", -1), 2, F.size(F.split(path, "/", -1)))
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolved(page: Column, link: Column) -> Column:
    """The address that ``link`` has on the page at ``page``; null without a host.

    A leading scheme makes it absolute, whatever stands further on. ``//host`` takes the page's scheme,
    ``/path`` its host, ``?query`` its path, and anything else its folder; ``.`` and ``..`` are worked off.
    """
    base = F.regexp_extract(page, r"^((?s:.*?)://[^/?#]*)", 1)
    here = path_of(page)
    bare, query = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(\?[^#]*)", 1)
    folder = F.when(F.instr(here, "/") > 0, F.regexp_extract(here, r"^((?s:.*)/)", 1)).otherwise(F.lit("/"))
    path = F.when(bare == "", here).when(bare.startswith("/"), _without_dots(bare)).otherwise(_without_dots(F.concat(folder, bare)))
    return (
        F.when(link.rlike(SCHEME), F.when(link.rlike(SCHEME + "//"), link))
        .when(link.startswith("//"), F.concat(F.regexp_extract(page, r"^((?s:.*?):)//", 1), link))
        .when(page.contains("://"), F.concat(base, path, query))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): each page's URL and the URLs of its canonical links and refresh redirects.

    ``canonical`` may be one of several rel values. Links of any form are resolved against the
    page's URL, and URLs are told apart without their fragment. Links to no host (``mailto:``) are no edges.
    """
    tags = pages.filter("url is not null and html is not null").select("url", F.explode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0))).alias("tag"))
    target = F.coalesce(*[F.when(F.regexp_extract("tag", p, 1) != "", F.regexp_extract("tag", p, 1)) for p in (CANONICAL, REFRESH)])
    links = tags.select("url", F.replace(target, F.lit("&amp;"), F.lit("&")).alias("to")).filter("to is not null")
    ends = links.select("url", resolved(F.col("url"), F.col("to")).alias("to")).filter("to is not null")
    return ends.select(node(F.col("url")).alias("a"), node(F.col("to")).alias("b")).distinct()


def node(url: Column) -> Column:
    """A URL without its fragment, host in lower case."""
    bare = F.substring_index(url, "#", 1)
    at = F.regexp_extract(bare, r"^(?s:.*?)://[^/?#]*", 0)
    return F.concat(F.translate(at, UPPER, LOWER), F.substr(bare, F.length(at) + 1))


def judge(pages: DataFrame, edges: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url).

    A rule's verdict holds for the pages it fits. Pages that no rule fits take the verdict of their
    alias class, the component of their URL in ``edges`` (a, b: URLs, pages or not): allow if a rule
    allows any member, else block if a rule blocks any, else allow. A null url or one without
    ``://`` has empty host and path and no aliases.
    """
    url = F.col("url")
    parts = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = decide(F.col("host"), F.col("path"), rules)
    own = parts.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("own"))
    members = connected(edges)
    said = members.select("component", decide(host_of(F.col("node")), path_of(F.col("node")), rules)[1].alias("word"))
    classes = said.groupBy("component").agg(F.max(F.col("word") == "block").alias("blocked"), F.max(F.col("word") == "allow").alias("allowed"))
    blocked = classes.filter("blocked and not coalesce(allowed, false)").select("component")
    aliases = members.join(blocked, "component").select(F.col("node").alias("alias")).withColumn("alias_verdict", F.lit("block"))
    # only pages without a rule and with a host look for their class
    asks = F.col("rule").isNull() & F.col("url").contains("://")
    asked = own.filter(asks).withColumn("alias", node(F.col("url"))).join(aliases, "alias", "left")
    settled = own.filter(~F.coalesce(asks, F.lit(False))).withColumn("alias_verdict", F.lit(None).cast("string"))
    out = asked.select(*own.columns, "alias_verdict").unionByName(settled)
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "alias_verdict", F.lit("allow")).alias("verdict"))


def op4(pages: DataFrame) -> DataFrame:
    """The query: all pages under the fixed rules, aliases from their own html."""
    return judge(pages, alias_edges(pages))


_HOST = "translate(regexp_extract({0}, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({0}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"


def _case(host: str, path: str, column: int) -> str:
    whens = []
    for rule in sorted(RULES, key=lambda r: -len(r[0] + r[1])):
        value = (rule[0] + rule[1], rule[2])[column]
        whens.append(f"WHEN ({host} = '{rule[0]}' OR {host} LIKE '%.{rule[0]}') AND starts_with({path}, '{rule[1]}') THEN '{value}'")
    return "CASE " + " ".join(whens) + " END"


#: The tables' html holds neither canonical links nor redirects; pages that have one would fail the comparison.
OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce({_HOST.format("url")}, '') AS host, coalesce({_PATH.format("url")}, '') AS path FROM pages)
SELECT page_id, host, path, {_case("host", "path", 0)} AS rule, coalesce({_case("host", "path", 1)}, 'allow') AS verdict FROM p
"""
