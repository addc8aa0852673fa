from signalmill.llm import redirects as R

PAGES = [
    (0, "https://a.org/x", '<link rel="canonical" href="https://www.Example.net/de/81">'),  # alias of a blocked page
    (1, "http://b.org/1", "<META HTTP-EQUIV='refresh' content='0; URL=https://a.org/x'>"),  # alias of an alias
    (2, "http://c.org/1?q=1#f", "<link href=http://b.org/1 rel=canonical>"),
    (3, "http://c.org/1?q=1", "<p>plain</p>"),  # the same page as 2 without its fragment
    (4, "https://sub.example.com/en/7/a", '<link rel="canonical" href="https://a.org/other">'),
    (5, "https://x.com/en/1", "<p/>"),
    (6, "https://x.com/EN/1", None),
    (7, "https://d.org/1", '<link rel="canonical" href="https://x.com/en/1"><link rel=canonical href="https://y.net/de/1">'),  # one blocked, one allowed
    (8, "HTTP://Es.Org/es/", "<link rel='stylesheet' href='https://x.com/en/1'>"),
    (9, None, '<link rel="canonical" href="https://x.com/en/1">'),
    (10, "no scheme", "x"),
    (11, "ftp://", ""),
    (12, "https://e.org/1", '<link rel="canonical" href="/2">'),
    (13, "https://e.org/2", '<meta http-equiv="refresh" content="5;url=https://z.com/en/&amp;1">'),
    (13, "https://e.org/2", '<meta http-equiv="refresh" content="5;url=https://z.com/en/&amp;1">'),
    (14, "http://evilcom/en/", ""),
    (None, "https://a.org/x", None),
]


def test_pages(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(4)
    want = {
        0: ("a.org", "/x", None, "block"), 1: ("b.org", "/1", None, "block"), 2: ("c.org", "/1", None, "block"), 3: ("c.org", "/1", None, "block"),
        4: ("sub.example.com", "/en/7/a", "example.com/en/7", "allow"), 5: ("x.com", "/en/1", "com/en/", "block"), 6: ("x.com", "/EN/1", None, "allow"),
        7: ("d.org", "/1", None, "allow"), 8: ("es.org", "/es/", "org/es/", "block"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("", "", None, "allow"),
        12: ("e.org", "/1", None, "block"), 13: ("e.org", "/2", None, "block"), 14: ("evilcom", "/en/", None, "allow"), None: ("a.org", "/x", None, "block"),
    }
    got = R.op4(df).collect()
    assert len(got) == len(PAGES) and {r[0]: tuple(r)[1:] for r in got} == want
    from pyspark.sql import functions as F

    more = df.select("*", *[F.lit(1).alias(c) for c in ("host", "path", "rule", "verdict", "alias", "node", "a")])
    assert {r[0]: tuple(r)[1:] for r in R.op4(more).collect()} == want
    assert R.op4(df.limit(0)).collect() == []


def test_many_aliases_of_one_page(spark):
    """A third of all pages point at one, and a long chain of redirects ends at a blocked one."""
    rows = [(i, f"http://h{i}.org/p", '<link rel="canonical" href="http://hub.org/p">' if i % 3 == 0 else "") for i in range(600)]
    rows += [(1000 + i, f"http://c.org/{i}", f'<link rel="canonical" href="http://c.org/{i + 1}">' if i < 200 else '<link rel="canonical" href="http://c.com/en/">') for i in range(201)]
    rows += [(5000, "http://hub.org/p", '<link rel="canonical" href="http://q.example.net/de/8">')]
    got = {r["page_id"]: r["verdict"] for r in R.op4(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {r[0]: "block" if r[0] >= 1000 or r[0] % 3 == 0 else "allow" for r in rows}


def test_every_form_of_link(spark):
    """Relative links as the standard library resolves them, whatever the query string holds."""
    from urllib.parse import urljoin

    from pyspark.sql import functions as F

    pages = ["https://a.org/x/y/z?q=http://no.com/en/", "http://b.org", "http://b.org/", "https://c.org/d/e/", "ftp://h.org/a/b"]
    links = ["page2.html", "../x", "../../../x/./y/..", "?p=3", "/go?u=http://x.com/en/1", "//y.net/de/8", "http://x.com/en/1", "./", ".", "..", "/a/../b/", "sub/x?y=../z", "HTTPS://Q.org/A", "/a//b"]
    rows = [(p, l) for p in pages for l in links]
    got = spark.createDataFrame(rows, "page string, link string").select("page", "link", R.resolved(F.col("page"), F.col("link")).alias("to")).collect()
    for r in got:
        want = urljoin(r["page"], r["link"]).replace("https://Q.org/A", "HTTPS://Q.org/A")
        assert r["to"] == want, (r["page"], r["link"])
    assert spark.range(1).select(R.resolved(F.lit("https://a.org/"), F.lit("mailto:x@y.com")).alias("to")).first()["to"] is None


def test_relative_links_and_rel_tokens_block(spark):
    rows = [
        (0, "https://e.org/a/1", '<link rel="alternate canonical" href="../b/2?p=1">'),
        (1, "https://e.org/b/2?p=1", "<link href=/c rel='shortlink canonical'>"),
        (2, "https://e.org/c", '<meta http-equiv="refresh" content="0; url=https://x.com/en/1?u=://">'),
        (3, "https://f.org/1", '<link rel="not-canonical" href="https://x.com/en/1">'),
        (4, "https://f.org/2", '<link data-rel="canonical" href="https://x.com/en/1">'),
        (5, "https://f.org/3", '<link rel="canonical" href="/go?u=https://x.com/en/1">'),
    ]
    got = {r["page_id"]: r["verdict"] for r in R.op4(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
