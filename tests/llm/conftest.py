import random

import pytest

LANGS = {"en": ["the", "of", "thing", "water", "house", "green", "walks", "over", "bridge", "north", "small", "river"],
         "de": ["der", "und", "haus", "wasser", "brücke", "klein", "grün", "läuft", "über", "nord", "fluss", "stein"]}


def prose(seed, words, lang="en"):
    r = random.Random(seed)
    return " ".join(r.choice(LANGS[lang]) + r.choice(["", "", "s", "en", "ly", str(r.randrange(30))]) for _ in range(words))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty, blank, very long and repeated texts, and extra columns with common names."""
    near = prose(7, 200).split()
    other = near[:100] + ["changed"] + near[101:]
    rows = [(1, None, "s", "en"), (2, "", "s", "en"), (3, " \t\n ", None, None), (4, prose(1, 30), "s", "en"),
            (5, prose(1, 30), "t", "en"), (6, " ".join(near), "t", "de"), (7, " ".join(other), None, "de"),
            (8, prose(8, 30000), "u", "en"), (9, prose(9, 300, "de"), "u", None), (9, prose(9, 300, "de"), "u", None),
            (None, prose(10, 50), "s", "en"), (11, "one two three", "s", "en"), (12, "Ünïcode <|endoftext|> ½ 日本 \x00 x", "s", "en"),
            (13, "spam spam " * 200, "s", "en")]
    extra = [(*r, i, "x", None) for i, r in enumerate(rows)]
    return spark.createDataFrame(
        extra, "doc_id long, text string, source string, lang string, n long, `class` string, verdict string").repartition(3)


@pytest.fixture(scope="session")
def bare(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n long, `class` string, verdict string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (6, 1, 0), (9, 1, 0), (13, 0, 0), (99, None, 1), (None, 1, 1)],
                                 "doc_id long, quality int, toxic int")
