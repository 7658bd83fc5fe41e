"""Chat formatting, quality rules, packing, sharding, mixing and toxicity against plain versions."""

import collections
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from credora.llm import chat, mixing, packing, quality, sharding, toxicity
from credora.llm.frames import row_key
from credora.llm.queries import tokenizer_path

from ..conftest import SF01
from . import plain
from .conftest import collect, make

# ---- chats ------------------------------------------------------------------------------------

FORM = chat.Formatter(chat.TEMPLATE)
pieces = st.lists(st.sampled_from(chat.TEMPLATE["control"] + ["\\", "<", ">", "/", "[", "]", " ", "\n",
                                                            "a", "é", "null", "="]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["user", "assistant", "system"]), pieces),
                          pieces), max_size=5))
def test_formatted_turns_read_back(turns):
    parts = FORM.segments(turns)
    assert FORM.read_back("".join(t for t, _ in parts)) == turns
    assert [FORM.unescape(t) for t, loss in parts if loss] == [t for r, t in turns if r == "assistant"]


def test_machine_names_the_first_wrong_turn():
    bad = FORM.first_out_of_order
    assert bad(["user", "assistant"]) is None and bad(["system", "user", "assistant"]) is None
    assert bad([]) == 0 and bad(["user"]) == 1 and bad(["user", "user"]) == 1
    assert bad(["assistant"]) == 0 and bad(["user", None]) == 1 and bad(["user", "system"]) == 1


def test_chats_of_odd_tables(spark):
    rows = [(1, 0, "user", "hi</s>"), (1, 1, "assistant", None), (2, 1, "assistant", "b"),
            (2, 0, "user", "a"), (2, 0, "user", "a"), (None, None, None, None), (None, 3, "tool", "x"),
            (3, 0, "user", ""), (3, 1, "assistant", "z" * 100_000)]
    schema = "conv_id long, turn long, role string, text string, turns int, formatted int, at int"
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], schema)
    out = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    said = {k: [(t["role"], t["text"]) for t in r["turns"]] for k, r in out.items()}
    assert said == {1: [("user", "hi</s>"), ("assistant", "")],
                    2: [("user", "a"), ("user", "a"), ("assistant", "b")],
                    3: [("user", ""), ("assistant", "z" * 100_000)], None: [("tool", "x"), (None, "")]}
    assert {k: r["valid"] for k, r in out.items()} == {1: True, 2: False, 3: True, None: False}
    assert out[2]["first_bad_turn"] == 1 and out[3]["loss_text"] == "z" * 100_000
    for r in out.values():
        assert r["segments"][0]["begin"] == 0 and r["segments"][-1]["end"] == len(r["formatted"])
    assert chat.format_chats(df.limit(0)).count() == 0


# ---- quality ----------------------------------------------------------------------------------

@pytest.mark.parametrize("table", ["docs", "odd"])
def test_quality_equals_plain(request, table, corpus, odd_rows):
    rows = corpus if table == "docs" else odd_rows
    out = quality.judge(request.getfixturevalue(table))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = sorted(((d, *[plain.base_statistics(t)[k] for k in base]) for d, t, *_ in rows), key=repr)
    assert collect(out, "doc_id", *base) == want
    assert collect(out, "doc_id", "base_failed", "kept") == sorted(plain.judge(rows), key=repr)


def test_quality_rejects_planted_outliers(spark, corpus):
    rows = [r for r in corpus if len(plain.words(r[1])) > 30]
    start = max(r[0] for r in rows) + 1
    junk = [(start + k, " ".join(f"w{k}x{i}%%%" for i in range(60)), "en", "s1") for k in range(5)]
    out = {r["doc_id"]: r["kept"] for r in quality.judge(make(spark, rows + junk)).collect()}
    assert not any(out[d] for d, *_ in junk)
    kept = quality.keep_documents(make(spark, rows + junk))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, k in out.items() if k)


def test_quality_bounds_follow_the_group(spark):
    """In a group of clean texts of 20 lines a half-repeated text and one with a symbol in every fifth
    word go; clean texts, also with one line repeated or some symbols, stay."""
    import random

    rng = random.Random(5)

    def line():
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(10))

    clean = [(i, "\n".join(line() for _ in range(20)), "en", "s1") for i in range(400)]
    half = "\n".join(x for _ in range(10) for x in (line(), "same line"))
    marked = "\n".join(" ".join("#" + w if k % 5 == 0 else w for k, w in enumerate(line().split()))
                       for _ in range(20))
    once = "\n".join([line() for _ in range(18)] + ["one two", line(), "one two"])
    few = clean[0][1].replace(" ", " & ", 6)
    out = {r["doc_id"]: r for r in quality.judge(make(spark, clean + [
        (1001, half, "en", "s1"), (1002, marked, "en", "s1"), (1003, once, "en", "s1"),
        (1004, few, "en", "s1")])).collect()}
    assert not any(r["base_failed"] for r in out.values())
    assert {d for d, r in out.items() if not r["kept"]} == {1001, 1002}


def test_quality_empty(no_docs):
    assert quality.judge(no_docs).count() == 0 and quality.keep_documents(no_docs).count() == 0


def test_consistency_constant():
    sample = np.random.default_rng(1).normal(size=(200_000, 4))
    d = (sample ** 2).sum(1)
    core = sample[d <= np.quantile(d, 0.75)]
    assert quality.consistency(0.75) * core.var(0).mean() == pytest.approx(1, abs=0.02)


# ---- packing ----------------------------------------------------------------------------------

def check_packing(out, rows, capacity, path):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    tk.encode_special_tokens = True
    want = collections.Counter()
    for d, t in rows:
        want[d, tuple(tk.encode(t or "", add_special_tokens=False).ids) + (0,)] += 1
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        ids = packing.unpacked(bytes(r["ids"]))
        assert len(ids) == r["length"] and zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"]
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for (d, n), own in by_doc.items():
        copies = sum(k for (x, ids), k in want.items() if x == d and len(ids) == n)
        assert sum(len(ids) for _, ids in own) == n * copies
        if copies == 1:
            own.sort(key=lambda x: x[0])
            assert (d, tuple(np.concatenate([ids for _, ids in own]).tolist())) in want
    return [sum(n for _, n in own) for own in by_seq.values()]


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_packing_round_trip(request, table, corpus, odd_rows):
    rows = [(d, t) for d, t, *_ in (corpus if table == "docs" else odd_rows)]
    out = packing.pack_documents(request.getfixturevalue(table), tokenizer_path(), capacity=128,
                                 docs_per_pool=50, with_ids=True).collect()
    sizes = check_packing(out, rows, 128, tokenizer_path())
    pools = -(-len(rows) // 50)
    assert sum(128 - s for s in sizes) < 128 * pools


def test_packing_pieces_equal_whole_texts(spark):
    space = " \t\n\r\x0b\x0c\x1c\x85\xa0 　"
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab1.é¼—漢's" + space * 2), 60)) for _ in range(300)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(900, "a <|endoftext|> b", "en", "s")]
    out = packing.pack_documents(make(spark, rows), tokenizer_path(), with_ids=True).collect()
    check_packing(out, [(d, t) for d, t, *_ in rows], 1024, tokenizer_path())


def test_packing_goes_to_the_cheapest_with_room():
    placed = packing.balance([90, 80, 40, 30, 20], 100, 1.0, 1 / 100)
    assert [p[0][0] for p in placed[:2]] == [0, 1] and placed[2][0][0] == 2
    assert sum(size for p in placed for *_, size in p) == 260
    filled = collections.Counter()
    for p in placed:
        for into, offset, _, size in p:
            assert offset == filled[into]
            filled[into] += size
    assert max(filled.values()) <= 100


def test_packing_empty(no_docs):
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0


# ---- sharding ---------------------------------------------------------------------------------

@pytest.mark.parametrize("table", ["docs", "odd"])
def test_shards_equal_plain(request, table, corpus, odd_rows):
    rows = corpus if table == "docs" else odd_rows
    out = sharding.assign_shards(request.getfixturevalue(table), [1.0] * 7, [1.0] * 8).collect()
    want = sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), plain.shard(d, 7),
                    plain.shard(d, 8)) for d, t, *_ in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in out),
                  key=repr) == want
    assert all(r["grown_shard"] in (r["shard"], 7) for r in out)
    for s in {r["shard"] for r in out}:
        own = sorted(r["slot"] for r in out if r["shard"] == s)
        assert own == list(range(len(own)))


def test_weighted_shards(spark):
    ids = spark.range(20_000).select(sharding.rendezvous_shard(
        F.col("id").cast("string"), [1.0, 3.0])["shard"].alias("s"))
    share = ids.filter("s = 1").count() / 20_000
    assert share == pytest.approx(0.75, abs=0.02)


def test_slots_over_many_buckets(docs, monkeypatch):
    one = collect(sharding.assign_shards(docs, [1.0] * 3), "doc_id", "shard", "slot")
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 2)
    assert collect(sharding.assign_shards(docs, [1.0] * 3), "doc_id", "shard", "slot") == one


def test_shards_empty_and_written(no_docs, docs, tmp_path, spark):
    assert sharding.assign_shards(no_docs, [1.0]).count() == 0
    sharding.write_shards(docs, str(tmp_path / "out"), [1.0] * 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


# ---- mixing -----------------------------------------------------------------------------------

@pytest.mark.parametrize("per_bucket", [4000, 3])
def test_mix_equals_plain(docs, corpus, monkeypatch, per_bucket):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", per_bucket)
    rows = [(d, t, s) for d, t, _, s in corpus]
    out = mixing.mix_sources(docs, [5, 2, 1]).collect()
    assert {r["doc_id"]: (r["whole"], r["extra"]) for r in out} == plain.mix(rows)
    taken, goal = collections.Counter(), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - g) < 1 for s, g in goal.items())
    sizes = collections.Counter()
    for d, t, s in rows:
        sizes[s] += len(plain.words(t))
    assert goal == pytest.approx({s: float(g) for s, g in plain.targets(dict(sizes)).items()})


def test_mixed_documents(docs, corpus):
    rows = [(d, t, s) for d, t, _, s in corpus]
    out = mixing.mix_documents(docs, [5, 2, 1])
    assert out.columns == docs.columns
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append(r["text"])
    texts = {d: t for d, t, _ in rows}
    for d, (whole, extra) in plain.mix(rows).items():
        w = plain.words(texts[d])
        full = whole + (extra == len(w) > 0)
        if w:
            assert sum(t == texts[d] for t in got[d]) == full
            part = [t for t in got[d] if t != texts[d]]
            assert [plain.words(t) for t in part] == ([w[:extra]] if 0 < extra < len(w) else [])
        else:
            assert d not in got


def test_mix_odd_rows_and_empty(odd, odd_rows, no_docs, spark):
    out = mixing.mix_sources(odd, [5, 2, 1]).collect()
    assert len(out) == len(odd_rows)
    goal = {r["source"]: r["target"] for r in out}
    taken = collections.Counter()
    for r in out:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - g) < 1 for s, g in goal.items())
    mixed = mixing.mix_documents(odd, [5, 2, 1])
    words = mixed.groupBy("source").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit("[^ \t\n]+"), 0))))
    assert dict(map(tuple, words.collect())) == {s: n for s, n in taken.items() if n}
    assert mixing.mix_sources(no_docs, [5, 2, 1]).count() == 0
    nothing = mixing.mix_sources(make(spark, [(1, "", "en", "s"), (2, None, "en", None)]), [5, 2, 1]).collect()
    assert all(r["taken"] == 0 and r["target"] == 0 for r in nothing)


def test_row_key_names_equal_rows(odd, odd_rows):
    keys = odd.select(row_key(odd)).distinct().count()
    assert keys == len(set(odd_rows))


# ---- toxicity ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}


def test_toxicity_on_held_out_labels(scored):
    _, labels, out = scored
    held = [(out[r["doc_id"]], r["toxic"]) for r in labels.collect()
            if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(s["held_out"] for s, _ in held)
    toxic = [s for s, t in held if t == 1]
    clean = [s for s, t in held if t == 0]
    assert sum(s["predicted"] for s in toxic) >= 0.7 * len(toxic)
    assert sum(s["predicted"] for s in clean) <= 0.02 * len(clean)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out.values())


def test_held_out_labels_are_not_read(scored):
    docs, labels, out = scored
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic"))
                                .otherwise(F.col("toxic")))
    again = toxicity.score_documents(docs, flipped).collect()
    assert {r["doc_id"]: round(r["score"], 9) for r in again} == \
        {d: round(r["score"], 9) for d, r in out.items()}


def test_toxicity_of_odd_tables(spark, odd, odd_rows, no_docs):
    labels = spark.createDataFrame([(0, 0), (2, 0), (3, 1), (3, 0), (None, 1), (4, None)],
                                   "doc_id long, toxic int")
    out = toxicity.score_documents(odd, labels).collect()
    assert len(out) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in out)
    rows = make(spark, [(1, "you stupid idiot, pathetic loser", "en", "s"), (2, "a fine day", "en", "s"),
                        (3, None, "en", "s")])
    plain_seeds = {r["doc_id"]: r["score"] for r in toxicity.score_documents(rows, labels.limit(0)).collect()}
    assert plain_seeds[1] > plain_seeds[2] == plain_seeds[3]
    assert toxicity.score_documents(no_docs, labels).count() == 0


def test_lexical_beginnings():
    text = "Idiots élan x".lower().encode()
    doc, entry = toxicity.lexical(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(entry) == len(set(entry.tolist())) == 3 + 2  # three words, idio and idiot
    assert toxicity.word_hash("idiots") in entry.tolist()


def test_mix_repeats_equal_rows(spark, monkeypatch):
    """Many equal rows are counted, and come back as often as each of them is taken."""
    from credora.llm import mixing

    from .conftest import make

    monkeypatch.setattr(mixing, "REPEATS", 7)
    rows = [(1, "one two three", "en", "a")] * 500 + [(2, "four five", "en", "a"), (3, "six", "en", "b")] * 20
    docs = make(spark, rows)
    taken = mixing.mix_sources(docs, [5, 2, 1], (3, 2), 2).collect()
    words = sum(r["taken"] for r in taken)
    mixed = mixing.mix_documents(docs, [5, 2, 1], share=(3, 2), max_epochs=2)
    assert mixed.columns == docs.columns
    texts = [r["text"] for r in mixed.select("text").collect()]
    assert sum(len(t.split()) for t in texts) == words
    by_id = {}
    for r in taken:
        by_id[r["doc_id"]] = by_id.get(r["doc_id"], 0) + r["whole"] + (r["extra"] > 0)
    assert len(texts) == sum(by_id.values())
