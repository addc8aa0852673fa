import pytest

from signalmill.llm import lines as N

BLANK = " \t\r\x0b\x0c"


def brute(rows, sites):
    seen, first = {}, {}
    for doc, text, _, source, *_ in rows:
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            body = line.strip(BLANK)
            if body:
                seen.setdefault(body, set()).add(source or "")
                at = (doc is None, doc or 0, pos)
                first[body] = min(first.get(body, at), at)
    out = []
    for doc, text, *_ in rows:
        if text is not None:
            text = "\n".join(x for pos, x in enumerate(text.split("\n")) if len(seen.get(x.strip(BLANK), ())) < sites or first[x.strip(BLANK)] == (doc is None, doc or 0, pos))
        out.append((doc, text, len(text or "")))
    return sorted(out, key=str)


@pytest.mark.parametrize("sites", [2, 3, 7, 10])
def test_lines(spark, odd, odd_rows, clashing, sites):
    got = N.drop_widespread(odd, sites).select("doc_id", "text", "n_chars").collect()
    assert sorted(map(tuple, got), key=str) == brute(odd_rows, sites)
    assert set(N.drop_widespread(clashing, sites).columns) == set(clashing.columns)
    assert sorted(map(tuple, N.drop_widespread(clashing, sites).select("doc_id", "text", "n_chars").collect()), key=str) == brute(odd_rows, sites)


def test_many_sites_near_the_threshold(spark):
    """Lines on 290 to 310 sites against a threshold of 300: the sketch alone could not tell."""
    rows = [(s * 1000 + n, f"line {n}\nown {s} {n}", "en", f"site {s}", 1) for n in range(290, 311) for s in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    found = N.widespread(df, 300).count()
    assert found == 11
    kept = N.drop_widespread(df, 300).filter("text like 'line%'").count()
    assert kept == sum(range(290, 300)) + 11


def test_empty(none):
    assert N.drop_widespread(none).collect() == []
