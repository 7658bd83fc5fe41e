"""Line dedup, substring dedup, n-gram Jaccard join and fingerprints against plain versions."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from credora.llm import graph, jaccard, lines, spotsigs, substrings
from credora.llm.words import split_words

from . import plain
from .conftest import collect, make


def pairs(rows):
    return [(d, t) for d, t, *_ in rows]


# ---- lines ------------------------------------------------------------------------------------

@pytest.mark.parametrize("table", ["docs", "odd"])
def test_lines_equal_plain(request, table, corpus, odd_rows):
    rows = corpus if table == "docs" else odd_rows
    out = lines.dedup_lines(request.getfixturevalue(table), min_docs=4)
    assert collect(out, "doc_id", "n_lines", "n_dropped", "kept_text") == \
        sorted(plain.line_dedup(pairs(rows), 4), key=repr)


def test_lines_keep_columns(docs):
    out = lines.drop_frequent_lines(docs, min_docs=4)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_lines_min_chars_and_repeats(spark):
    rows = [(i, "ab\nab\né\nlonger line", "en", "s") for i in range(3)]
    out = lines.dedup_lines(make(spark, rows), min_docs=3, min_chars=3)
    assert {r["kept_text"] for r in out.collect()} == {"ab\nab\né"}
    once = lines.dedup_lines(make(spark, rows[:1] * 5), min_docs=2)
    assert all(r["n_dropped"] == 0 for r in once.collect())  # one document, however often listed


def test_lines_empty(no_docs):
    assert lines.dedup_lines(no_docs).count() == 0


# ---- substrings -------------------------------------------------------------------------------

@pytest.mark.parametrize("table", ["docs", "odd"])
@pytest.mark.parametrize("n", [3, 13])
def test_substrings_equal_plain(request, table, n, corpus, odd_rows):
    rows = corpus if table == "docs" else odd_rows
    out = substrings.dedup_substrings(request.getfixturevalue(table), n)
    assert collect(out, "doc_id", "n_words", "n_removed", "kept_text") == \
        sorted(plain.substring_dedup(pairs(rows), n), key=repr)


def test_substring_intervals_are_maximal(docs, corpus):
    texts = dict(pairs(corpus))
    for r in substrings.dedup_substrings(docs, 13).collect():
        w = plain.words(texts[r["doc_id"]])
        gone = [(s["begin"], s["end"]) for s in r["intervals"]]
        assert sum(e - b for b, e in gone) == r["n_removed"]
        assert all(b2 > e1 for (_, e1), (b2, _) in zip(gone, gone[1:]))
        kept = [x for i, x in enumerate(w) if not any(b <= i < e for b, e in gone)]
        assert " ".join(kept) == r["kept_text"]


def test_substrings_empty(no_docs):
    assert substrings.dedup_substrings(no_docs).count() == 0


def test_words_at_document_bounds():
    texts = ["ab", "cd e", "", " f", "g "]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    w = split_words(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(w.starts, w.ends)] == ["ab", "cd", "e", "f", "g"]
    assert w.counts.tolist() == [1, 2, 0, 1, 1]


# ---- n-gram Jaccard ---------------------------------------------------------------------------

@pytest.mark.parametrize("block", [512, 4])
def test_jaccard_equals_brute_force(docs, corpus, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(docs).collect()}
    assert out == plain.near_duplicates(pairs(corpus))


def test_jaccard_keeps_one_of_each_class(docs, corpus):
    found = plain.near_duplicates(pairs(corpus))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (c, _) in found.items() if c == d)


def test_jaccard_odd_rows(odd, odd_rows):
    out = collect(jaccard.near_duplicates(odd), "doc_id", "class_id", "n_links")
    assert len(out) == len(odd_rows)
    # a null id with the words of document 0 joins its class; null and repeated rows do not crash
    assert (None, 0) in {(d, c) for d, c, _ in out}


def test_jaccard_empty(no_docs):
    assert jaccard.near_duplicates(no_docs).count() == 0


def test_forest_shortens_until_recall():
    assert jaccard.forest_depth(0.8, 32, 8, 0.9999) == 6
    assert jaccard.forest_depth(0.8, 32, 8, 0.9) > jaccard.forest_depth(0.8, 32, 8, 0.999999)
    with pytest.raises(ValueError):
        jaccard.forest_depth(0.1, 2, 4, 0.999)


def test_recall_counts_what_did_not_meet():
    # a match at similarity s stands for 1 / (its probability to meet)
    p8 = 1 - (1 - 0.8 ** 8) ** 32
    assert jaccard.meeting(0.8, 8, 32) == pytest.approx(p8)
    assert jaccard.recall([], 0.8, 8, 32, 0.0) == pytest.approx(p8)
    assert jaccard.recall([(0.8, 10 ** 6)], 0.8, 8, 32, 0.0) == pytest.approx(p8, abs=1e-6)
    assert jaccard.recall([(0.95, 10 ** 4)], 0.8, 8, 32, 0.0) > 0.999999
    assert jaccard.recall([(0.5, 10 ** 6)], 0.8, 8, 32, 0.0) == pytest.approx(p8)  # no links


def _near(groups, words, edits, rng):
    """Pairs of a text and a copy with ``edits`` words changed, far from each other."""
    rows = []
    for g in range(groups):
        w = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
        v = list(w)
        for e in range(edits):
            v[(e + 1) * words // (edits + 1)] = f"x{g}y{e}"
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(v))]
    return rows


def test_forest_depth_follows_the_data(spark, monkeypatch):
    """Close copies keep long prefixes; copies near the threshold shorten them. Links are the same."""
    import random

    depths = []
    measure = jaccard.measured_depth
    monkeypatch.setattr(jaccard, "measured_depth", lambda *a: depths.append(measure(*a)) or depths[-1])
    for edits in (1, 4):  # Jaccard about 0.95 and 0.81
        rows = _near(150, 200, edits, random.Random(edits))
        out = jaccard.near_duplicates(make(spark, [(d, t, "en", "s") for d, t in rows]))
        assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out.collect()} == \
            {d: (d - d % 2, 1) for d, _ in rows}
    (close, high), (far, _) = depths
    assert close > far == jaccard.forest_depth(0.8, 32, 8, 0.9999)
    assert high >= 0.9999


@pytest.mark.parametrize("parts", ["1", "7"])
def test_forest_chains_connect_every_node(spark, parts):
    """Rows that share a prefix of d levels are connected by chains of depth d or more, also where
    their run is cut by a partition; rows that do not are not."""
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 40, (300, 4), dtype=np.uint64)  # two trees of two levels, few values
    sig[:90] = sig[0]  # one node of many rows
    paths = jaccard.tree_paths(sig, 2)
    classes = spark.createDataFrame([(i, p.tobytes()) for i, p in enumerate(paths)], "rep long, paths binary")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chains = jaccard._forest(classes, 2, 1, 2).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for depth in (1, 2):
        root = list(range(300))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in chains:
            if r["depth"] >= depth:
                root[max(find(r["a"]), find(r["b"]))] = min(find(r["a"]), find(r["b"]))
        want = list(range(300))
        for _ in range(300):
            last = list(want)
            for tree in (0, 1):
                low = {}
                keys = [tuple(p[2 * tree:2 * tree + depth]) for p in paths]
                for i, k in enumerate(keys):
                    low[k] = min(low.get(k, 300), want[i])
                want = [min(want[i], low[k]) for i, k in enumerate(keys)]
            if want == last:
                break
        assert [find(i) for i in range(300)] == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    df = spark.createDataFrame([(max(e), min(e)) for e in edges], "a long, b long")
    out = {r["node"]: r["root"] for r in graph.components(df).collect()}
    assert out == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(df.limit(0)).count() == 0


# ---- fingerprints -----------------------------------------------------------------------------

def test_fingerprint_edits(spark, docs, corpus):
    rows = sorted(pairs(corpus), key=lambda r: -r[0])
    texts = [t or "" for _, t in rows]
    want = {}
    for k, (d, _) in enumerate(rows):
        n, after = len(texts[k]) // 3, texts[(k + 1) % len(rows)]
        want[d] = texts[k][:len(texts[k]) - n] + after[:n]
    out = spotsigs.fingerprint_edits(docs).collect()
    assert {r["doc_id"]: r["edited"] for r in out} == want
    by_text = collections.defaultdict(set)
    for r in out:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text[dict(pairs(corpus))[r["doc_id"]] or ""].add(tuple(r["signatures"]))
        a, b = set(r["signatures"]), set(r["edited_signatures"])
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert all(len(s) == 1 for s in by_text.values())
    links = plain.near_duplicates(pairs(corpus))
    alone = [r for r in out if r["n_chars"] > 600 and links[r["doc_id"]][1] == 0]
    assert len(alone) > 5
    # a third is replaced: about half of the joint signatures stay (few spots in invented words)
    assert all(r["near_edited"] > r["near_next"] for r in alone)
    assert 0.35 < sum(r["near_edited"] for r in alone) / len(alone) < 0.65


def test_fingerprint_chains(spark):
    text = "The quick fox of a lazy dog"
    sig = spotsigs.with_signatures(spark.createDataFrame([(text,)], "t string"), F.col("t"), "s").first()["s"]
    chain = lambda *w: spark.range(1).select(F.xxhash64(*[F.lit(x) for x in w])).first()[0]
    assert {chain("quick", "fox"), chain("lazy", "dog")} <= set(sig)
    assert len(sig) <= 4  # and at most the words whose hash opens a spot


def test_fingerprint_odd_and_empty(odd, odd_rows, no_docs, spark):
    assert spotsigs.fingerprint_edits(odd).count() == len(odd_rows)
    assert spotsigs.fingerprint_edits(no_docs).count() == 0
    one = spotsigs.fingerprint_edits(make(spark, [(4, "abcdef", "en", "s")])).first()
    assert one["edited"] == "abcdab"  # its own neighbour
    gone = spotsigs.fingerprint_edits(make(spark, [(4, None, "en", "s"), (5, "", "en", "s")])).collect()
    assert all(r["near_next"] == 1.0 and r["edited"] == "" for r in gone)
    assert spotsigs.fingerprints(odd).count() == len(odd_rows)


def test_length_classes_bound_likeness(spark):
    df = spark.createDataFrame([(list(range(a)), list(range(b))) for a in (5, 40, 100) for b in (6, 50, 90)],
                               "a array<long>, b array<long>")
    rows = df.select(spotsigs.likeness(F.col("a"), F.col("b")).alias("near"),
                     (spotsigs.length_class(F.col("a"), 0.8)
                      - spotsigs.length_class(F.col("b"), 0.8)).alias("gap")).collect()
    assert all(abs(r["gap"]) <= 1 for r in rows if r["near"] >= 0.8)


def check_near(spark, docs, queries, threshold, **kw):
    from fractions import Fraction

    sets = {r["fingerprint"]: set(r["signatures"]) for r in spotsigs.fingerprints(docs).collect()}
    copies = collections.Counter(r["fingerprint"] for r in spotsigs.fingerprints(docs).collect())
    asked = {r["fingerprint"]: set(r["signatures"]) for r in spotsigs.fingerprints(queries).collect()}
    want = {}
    for q, a in asked.items():
        for f, b in sets.items():
            near = Fraction(len(a & b), len(a | b)) if a | b else Fraction(1)
            if near >= Fraction(threshold):
                want[q, f] = (copies[f], pytest.approx(float(near)))
    out = spotsigs.near_fingerprints(queries, docs, threshold, **kw).collect()
    assert len(out) == len(want)
    assert {(r["query"], r["fingerprint"]): (r["copies"], r["likeness"]) for r in out} == want
    return out


@pytest.mark.parametrize("threshold, share", [("0.8", 1000), ("0.5", 20), ("0.3", 1)])
def test_near_fingerprints_equal_brute_force(spark, docs, threshold, share):
    """Also where most signatures are frequent and where hardly any is."""
    out = check_near(spark, docs, docs.filter("doc_id % 3 = 0"), threshold, frequent_share=share, salts=3)
    assert any(0 < r["likeness"] < 1 for r in out) and any(r["copies"] > 20 for r in out)


def test_near_fingerprints_odd_and_empty(spark, odd, no_docs):
    check_near(spark, odd, odd, "0.8")
    assert spotsigs.near_fingerprints(no_docs, odd).count() == 0
    assert spotsigs.near_fingerprints(odd, no_docs).count() == 0


# ---- many rows of one id, many equal rows -----------------------------------------------------

def test_substrings_many_rows_of_one_id(spark):
    """Rows without an id are one document; each gets its own windows back, in linear time."""
    import time

    def table(n):
        rows = [(None, " ".join(f"w{i}x{j}" for j in range(30)), "en", "s") for i in range(n)]
        return rows + [(5, rows[3][1], "en", "s"), (6, "a b " + rows[7][1], "en", "s")] + rows[:1] * n

    small, large = table(300), table(3000)
    took = []
    for rows in (small, large):
        began = time.time()
        out = collect(substrings.dedup_substrings(make(spark, rows), 13), "doc_id", "n_words", "n_removed", "kept_text")
        took.append(time.time() - began)
        assert out == sorted(plain.substring_dedup(pairs(rows), 13), key=repr)
    assert took[1] < 10 * took[0] + 5
