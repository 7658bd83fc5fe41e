"""Phrase collocations against a count of every n-gram."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from credora.llm import phrases

from . import plain_words as plain
from .conftest import make


def found(df, **rules):
    out = phrases.collocations(df, **rules)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def expected(rows, **rules):
    return plain.collocations([(lang, t) for _, t, lang, _ in rows], **rules)


@pytest.fixture(scope="module")
def prose():
    """Common words, fixed phrases, ties and odd separators in three languages and in none."""
    rng = random.Random(9)
    words = ["the", "of", "and", "New", "york", "city", "hall", "é", "ÀB", "to", "be", "or", "x'y", "中", "1"]
    weights = [30, 20, 10] + [3] * 12
    rows = []
    for i in range(300):
        text = ""
        for _ in range(rng.randint(0, 60)):
            text += rng.choice([" ".join(rng.choices(words, weights)), "new York City", "to be or", "of the"])
            text += rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?", "\x0b", "\xa0"])
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None, "a\tb"]), "s"))
    return rows


@pytest.mark.parametrize("rules", [{}, {"min_count": 2, "top": 30}, {"longest": 2, "min_count": 3},
                                   {"longest": 4, "min_count": 3, "cover_percent": 80}])
def test_equals_every_ngram_counted(spark, prose, rules, monkeypatch):
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 3000)  # several buckets
    plain_rules = {{"cover_percent": "cover"}.get(k, k): v for k, v in rules.items()}
    want = expected(prose, **plain_rules)
    assert len(want) > 20
    assert found(make(spark, prose), **rules) == want


@pytest.mark.parametrize("hot", [True, False])
def test_hot_words_and_pairs_are_spread(spark, prose, monkeypatch, hot):
    """The same counts whichever windows are dealt to many buckets."""
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 500)
    monkeypatch.setattr(phrases, "HOT", 10 ** 6 if hot else 1)
    assert found(make(spark, prose), min_count=4) == expected(prose, min_count=4)


def test_hot_keys_are_bounded(spark, prose):
    words, pairs = phrases.hot_keys(make(spark, prose).select("lang", "text"), len(prose))
    assert 0 < len(words) <= phrases.HOT and 0 < len(pairs) <= phrases.HOT


def test_counts_of_prefixes(spark):
    rows = [(i, "a b c a b. a b d", "en", "s") for i in range(12)]
    got = {(r["lang"], tuple(r["words"])): r["f"] for r in phrases.prefix_counts(make(spark, rows), 3, 13).collect()}
    assert got == {("en", ()): 96, ("en", ("a",)): 36, ("en", ("b",)): 36, ("en", ("c",)): 12, ("en", ("d",)): 12,
                   ("en", ("a", "b")): 36}


def test_score_is_exact(spark):
    cases = [(10 ** 15, 10 ** 15, 10 ** 15), (10 ** 15 - 1, 10 ** 15, 10 ** 15 - 1), (3, 7, 11), (10, 10, 10),
             (123456789012, 987654321098765, 123456789013)]
    df = spark.createDataFrame(cases, "a long, l long, r long")
    got = [r[0] for r in df.select(phrases.score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [1_000_000 * a * a // (x * y) for a, x, y in cases]
    assert Decimal(10 ** 36) == Decimal(1_000_000 * (10 ** 15) ** 2)


def test_wide_codes_are_sorted_alike():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 9, 500) for _ in range(3)]
    (a, n), (b, m) = phrases._runs(columns, 9), phrases._runs(columns, 1 << 40)
    assert n.tolist() == m.tolist() and all(x.tolist() == y.tolist() for x, y in zip(a, b))


def test_odd_empty_and_repeated(spark, odd, odd_rows, no_docs):
    assert found(odd, min_count=2) == expected(odd_rows, min_count=2)
    assert found(no_docs) == []
    many = [(7, "one row many times. one row", "en", "s")] * 40
    assert found(make(spark, many)) == expected(many)
    long = [(1, "a b " * 200_000 + "z" * 100_000 + " z", "en", "s")]
    assert found(make(spark, long)) == expected(long)
