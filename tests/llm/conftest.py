"""Small tables with the hard cases: nulls in any column, empty and very long
texts, ties, repeated rows, and an extra column whose name clashes."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score double, size string"


def _prose(seed: int, words: int, lang: str = "en") -> str:
    rng = random.Random(seed)
    parts = {"en": ["the", "and", "th", "er", "ing", "on", "wh", "ea", "st"], "de": ["der", "sch", "ung", "ei", "zu", "pf", "keit", "ö"]}[lang]
    text = [rng.choice(parts) + rng.choice(parts) + (rng.choice(parts) if rng.random() < 0.7 else "") for _ in range(words)]
    return " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(text))


@pytest.fixture(scope="session")
def prose():
    return _prose


@pytest.fixture(scope="session")
def hard_rows():
    rows = [(i, _prose(i, 20 + 7 * i, "de" if i % 3 == 0 else "en"), "de" if i % 3 == 0 else "en", f"s{i % 4}", None, "x", 0.5, "y") for i in range(24)]
    rows += [(100, None, "en", "s0", None, None, None, None), (101, "", None, None, 0, "x", 1.0, "y"), (102, " \n\t ", "en", None, 3, "x", 1.0, "y"),
             (103, "*** 123 !!!", None, "s1", 11, "x", 1.0, "y"), (104, _prose(7, 60_000), "en", "s1", None, "x", 1.0, "y"),
             (None, _prose(8, 40), "en", "s2", None, "x", 1.0, "y"), (105, _prose(5, 55), "en", "s2", None, "x", 1.0, "y")]
    rows += [rows[5], rows[5], (5, "another text with that id", "en", "s1", None, "x", 1.0, "y"), (200, rows[6][1], None, "s3", None, "x", 1.0, "y"),
             (201, rows[6][1].replace(" ", "  "), "en", "s3", None, "x", 1.0, "y")]
    return rows


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame(hard_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
