"""Spelling variants against all-pairs comparison."""

import random

import numpy as np
import pyarrow as pa
import pytest

from credora.llm import spelling

from . import plain_words as plain
from .conftest import make


def found(df, **rules):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"])
            for r in spelling.group_variants(df, **rules).collect()}


def pairs(rows):
    return [(d, t) for d, t, *_ in rows]


@pytest.fixture(scope="module")
def misspelt():
    """Frequent words with rarer edits of them, chains of edits, ties, anagrams and long words."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    words = []
    for w in base:
        words += [w] * rng.choice([3, 6, 12, 24])
        for _ in range(4):
            k = rng.randrange(len(w))
            words += [rng.choice([w[:k] + w[k + 1:], w[:k] + "x" + w[k:], w[:k] + "y" + w[k + 1:]])] * rng.choice([3, 6, 12])
    words += ["abcde"] * 40 + ["Abcdx"] * 20 + ["abcxx"] * 10 + ["abxxx"] * 5 + ["aabcde"] * 40 + ["ABCDÉ"] * 3
    words += ["".join(rng.sample("aabbccdd", 8)) for _ in range(400)] * 3
    words += ["long" * 60] * 6 + ["long" * 60 + "g"] * 3 + ["x" + "long" * 60] * 3 + ["z" * 300] * 3
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 60:(i + 1) * 60]) + rng.choice(["", ".", "中7"]), "en", "s")
            for i in range(len(words) // 60 + 1)]
    return rows


@pytest.mark.parametrize("subtree", [8192, 20, 1])
def test_variants_equal_all_pairs(spark, misspelt, monkeypatch, subtree):
    monkeypatch.setattr(spelling, "SUBTREE_WORDS", subtree)
    monkeypatch.setattr(spelling, "INNER_NODES", 1 << 40)
    want = plain.spelling_variants(pairs(misspelt))
    assert any(r != f for f, r, *_ in want.values() if f)  # chains longer than one
    assert found(make(spark, misspelt)) == want


def test_other_rules(spark, misspelt):
    want = plain.spelling_variants(pairs(misspelt), modulus=7, min_chars=3, min_count=2, ratio=3)
    assert found(make(spark, misspelt), modulus=7, min_chars=3, min_count=2, ratio=3) == want


@pytest.mark.parametrize("big", [0, 256])
def test_subtree_search(misspelt, monkeypatch, big):
    """The search inside one task, with the index of halves for all leaves or for none, in small parts."""
    for name, value in (("BIG_LEAF", big), ("BLOCK", 7), ("STATES", 50), ("PAIRS", 33), ("WIDE", 8)):
        monkeypatch.setattr(spelling, name, value)
    want = plain.spelling_variants(pairs(misspelt))
    words = [w.encode("latin-1") for w in want]
    n = [v[2] for v in want.values()]
    rows = pa.table({"member": [True] * len(words) + [False] * len(words), "w": pa.array(words * 2, pa.binary()),
                     "n": pa.array(n * 2, pa.int64())})
    out = spelling._search(rows, spelling.letter_groups(np.bincount(np.frombuffer(b"".join(words), np.uint8), minlength=256)))
    near = {}
    for r in out.to_pylist():
        near[r["w"].decode("latin-1")] = near.get(r["w"].decode("latin-1"), 0) + r["near"]
    assert near == {w: v[3] for w, v in want.items()}


def test_odd_and_empty(spark, odd, odd_rows, no_docs):
    rows = odd_rows + [(None, "Variant variant variant variAnt variants variants variants", None, None)]
    assert found(make(spark, rows), min_count=2) == plain.spelling_variants(pairs(rows), min_count=2)
    assert found(no_docs) == {}
    many = [(7, "spelling spelling speling", "en", "s")] * 50  # one row many times
    assert found(make(spark, many)) == plain.spelling_variants(pairs(many))


def test_one_edit():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(2))
        assert spelling.one_edit(a.encode(), b.encode()) == plain.one_edit(a, b)
