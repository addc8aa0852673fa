import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    parts = ["ta", "ri", "mo", "lun", "ke", "so", "vi", "ber", "na", "dol"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty and very long texts, repeated rows, copies, ties and odd characters."""
    rng = random.Random(5)
    rows = [(i, "\n".join(words(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 4))), rng.choice(["en", "de", None]), f"s{i % 7}", 10) for i in range(60)]
    rows += [(100 + i, rows[3][1], "en", f"s{i}", 1) for i in range(12)]
    rows += [(120 + i, rows[4][1].replace(" ", "  ", i), "en", "s1", 1) for i in range(4)]
    rows += [(200, None, None, None, None), (201, "", "en", "s0", 0), (202, " \t\n\x0b ", "en", "s0", 5), (203, None, "en", "s2", None)]
    rows += [(210, "one", "en", "s1", 3), (211, "one", "en", "s2", 3), (211, "one", "en", "s2", 3), (None, "one two", "en", "s3", 7), (None, None, None, None, None)]
    rows += [(220, "Ünï çode ▁ 日本 😀 \x00 <|endoftext|> x", "fr", "s1", 1), (221, words(rng, 6000), "en", "s4", 1), (222, "x" * 20000, "en", "s5", 1), (223, "A a A a", "en", "s5", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with further columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["row", "word", "c", "k", "fp", "h1", "task", "nth", "length", "rank", "base", "kind", "piece", "start", "first", "multi", "sub", "len", "f1", "conv", "component", "_id", "_drop", "_chain", "x", "v", "n"]
    return odd.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
