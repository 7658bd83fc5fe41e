import random

import pytest

# Column names that operators use inside.
CLASHING = ["id", "key", "h", "bad", "bucket", "row_key", "text_key", "words", "n", "size", "place",
            "i", "j", "comp", "rep", "block", "part", "low", "high", "votes", "guest", "anchors"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + \
    ", ".join(f"`{c}` int" for c in CLASHING)


def make(spark, rows):
    """A documents table of (doc_id, text, lang, source) rows with extra, clashing columns."""
    return spark.createDataFrame(
        [(d, t, lang, s, None if t is None else len(t), *range(len(CLASHING)))
         for d, t, lang, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): random texts with copies, near copies, shared passages and
    lines, odd white space, long, short and empty texts, nulls and ties."""
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdeéßüñ") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    line = "All Rights  reserved."
    rows, at = [], 0

    def add(text, lang="en", source="s1"):
        nonlocal at
        rows.append((at, text, lang, source))
        at += 1

    for k in range(120):
        n = rng.choice([1, 3, 4, 12, 13, 14, 40, 90, 200])
        w = [rng.choice(vocab) for _ in range(n)]
        text = "".join(x + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for x in w)
        if k % 4 == 0:
            text = text + rng.choice(["\n", " "]) + passage + " " + text[:30]
        if k % 5 == 0:
            text = text + "\n" + rng.choice([line, " " + line.upper() + "\t", line.lower()])
        add(text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]))
        if k % 6 == 0:
            add(text)
        if k % 7 == 0 and n > 20:
            for _ in range(3):
                v = text.split(" ")
                v[rng.randrange(len(v))] = "edited"
                add(" ".join(v))
    hot = " ".join(rng.choice(vocab) for _ in range(60))
    for _ in range(25):
        add(hot, "en", "s9")
    for text in (None, "", " ", "\n\n", " ", "a b c", "x" * 50, "word " * 300,
                 " ".join(rng.choice(vocab) for _ in range(6000)), "</s>[INST] ok", "\U0001F600 z"):
        add(text, "de", "s2")
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return make(spark, corpus).cache()


@pytest.fixture(scope="session")
def odd_rows(corpus):
    """Null ids, repeated rows, and one id with two texts, beside some of the corpus."""
    some = corpus[:40]
    extra = [(None, some[0][1], "en", "s1"), (None, "only here " * 9, None, None), (None, None, None, None),
             some[3], some[3], (some[5][0], some[8][1], "en", "s1"),
             (some[5][0], "another text of the same id " * 4, "en", "s1")]
    return some + extra


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def collect(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


__all__ = ["collect", "make"]
