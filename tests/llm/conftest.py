import random

import pytest

WORDS = "the of and to in a is that for it on was with as by at from tion ing her ent ation ou ver ment".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", rng.choice(WORDS), rng.choice(WORDS) + rng.choice(WORDS)]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, lang, source): nulls, empty, short, very long, ties, copies, shared passages, odd characters."""
    rng = random.Random(4)
    passage, long = sentence(rng, 80), sentence(rng, 12_000)
    base = sentence(rng, 300)
    words = base.split()
    near = " ".join([*words[:150], "changed", *words[151:]])
    rows = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, "word", "en", "b"), (5, base, "en", "a"), (6, base, "fr", "b"), (7, near, "en", "a"),
        (8, sentence(rng, 60) + " " + passage + " " + sentence(rng, 40), "en", "c"), (9, sentence(rng, 10) + "\n" + passage, "de", "c"), (10, long, "en", "a"), (11, long[: len(long) // 2], "en", "a"),
        (12, "ha " * 400, "es", "d"), (13, "ha " * 400, "es", "d"), (14, "é😀ñ x " * 120, "es", "e"), (15, "x" * 6000, "en", "e"), (16, "\x0b\x0cfoo\rbar  baz", "en", "b"), (17, "123 !!! ???", "en", "b"),
        (18, "same line\nsame line\nother line\n" * 3, "en", "a"), (19, "SAME Words Here now", "en", "b"), (20, "same words here now", "en", "b"),
    ]
    rows += [(100 + k, sentence(rng, rng.randint(1, 120)), rng.choice(["en", "fr"]), rng.choice("abc")) for k in range(60)]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, "doc_id long, text string, lang string, source string").repartition(3)


@pytest.fixture(scope="session")
def texts(edge_rows):
    return {r[0]: r[1] or "" for r in edge_rows}


@pytest.fixture(scope="session")
def clashing(edge):
    """The same rows with extra columns named as columns that operators use inside."""
    from pyspark.sql import functions as F

    names = "spans h c lo n first copies kinds __text __words fp least node root component_id id slot shard label score size target taken block uses stratum bin base scored line host words gone __id".split()
    return edge.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def repeated(edge):
    return edge.unionByName(edge)
