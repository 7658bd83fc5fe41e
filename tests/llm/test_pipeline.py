"""The pipeline's stages, each on the plain version's output of the stage before."""

import collections

import __spark_entry__ as entry
import corpus_pipeline
from credora.llm import packing
from credora.llm.queries import tokenizer_path

from ..conftest import SF001
from . import plain
from .conftest import make

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_stages(rows):
    """(doc_id, text, lang, source) rows after each of the first four stages."""
    kept = {d for d, _, k in plain.judge(rows) if k}
    rows = [r for r in rows if r[0] in kept]
    yield rows
    texts = {d: t for d, _, _, t in plain.line_dedup([r[:2] for r in rows], 10)}
    rows = [(d, texts[d], lang, s) for d, _, lang, s in rows]
    yield rows
    classes = plain.near_duplicates([r[:2] for r in rows])
    rows = [r for r in rows if classes[r[0]][0] == r[0]]
    yield rows
    taken = plain.mix([(d, t, s) for d, t, _, s in rows])
    out = []
    for d, t, lang, s in rows:
        whole, extra = taken[d]
        out += [(d, t, lang, s)] * whole
        if extra:
            out.append((d, first_words(t, extra), lang, s))
    yield out


def first_words(text, n):
    at = 0
    for m in plain.WORD.finditer(text):
        n -= 1
        at = m.end()
        if n == 0:
            break
    return text if not plain.WORD.search(text, at) else text[:at]


def test_stages_equal_plain(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "near_duplicates", "source_mix", "packing"]
    sizes = []
    for (name, stage), want in zip(corpus_pipeline.STAGES, plain_stages(rows)):
        out = stage(spark, docs, SF001)
        assert out.columns == COLUMNS, name
        got = collections.Counter(tuple(r) for r in out.collect())
        assert got == collections.Counter((d, t, lang, s, len(t)) for d, t, lang, s in want), name
        docs = spark.createDataFrame([(d, t, lang, s, len(t)) for d, t, lang, s in want], docs.schema)
        sizes.append(len(want))
    assert sizes[0] < len(rows) and sizes[2] < sizes[1] and sizes[3] > sizes[2]
    _, pack = corpus_pipeline.STAGES[-1]
    pieces = pack(spark, docs, SF001).collect()
    check(pieces, want)


def check(pieces, rows):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    tokens = collections.Counter()
    for d, t, *_ in rows:
        tokens[d] += len(tk.encode(t, add_special_tokens=False).ids) + 1
    packed, filled = collections.Counter(), collections.Counter()
    for r in pieces:
        packed[r["doc_id"]] += r["length"]
        filled[r["sequence_id"]] += r["length"]
    assert packed == tokens and max(filled.values()) <= 1024


def test_packed_sequences_hold_every_copy(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    long = " ".join(f"word{k} of many" for k in range(9000))
    rows = [(1, long), (1, long), (1, long[:700]), (2, "a b c"), (2, "a b"), (None, "x"), (None, "x")]
    docs = make(spark, [(d, t, "en", "s1") for d, t in rows]).select(COLUMNS)
    parts = collections.defaultdict(list)
    for r in corpus_pipeline.pack(spark, docs, "").collect():
        parts[r["row"], r["doc_id"]].append((r["start"], packing.unpacked(bytes(r["ids"])).tolist()))
    got = collections.Counter((d, tuple(x for _, ids in sorted(p) for x in ids))
                              for (_, d), p in parts.items())
    assert got == collections.Counter(
        (d, (*tk.encode(t, add_special_tokens=False).ids, 0)) for d, t in rows)


def test_added_tokens_keep_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    texts = ["end <|endoftext|> start", "x<|endoftext|>y", "a  <|endoftext|>  b <|endoftext|",
             "<|endoftext|><|endoftext|>", "<|endof", "text|> z", " \t<|endoftext|>'s."]
    docs = make(spark, [(k, t, "en", "s1") for k, t in enumerate(texts)]).select(COLUMNS)
    parts = collections.defaultdict(list)
    for r in corpus_pipeline.pack(spark, docs, "").collect():
        parts[r["doc_id"]].append((r["start"], packing.unpacked(bytes(r["ids"])).tolist()))
    got = {d: [x for _, ids in sorted(p) for x in ids] for d, p in parts.items()}
    assert got == {k: [*tk.encode(t, add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    assert 50256 in got[0]


def test_run_goes_through_all_stages(spark):
    out = corpus_pipeline.run(spark, SF001)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0


def test_stages_take_empty_and_odd_tables(spark, odd, no_docs):
    for table in (no_docs.select(COLUMNS), odd.select(COLUMNS)):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF001)
        assert (docs.count() == 0) == (table.count() == 0)


def test_clean_documents_stay(spark, corpus):
    clean = [r for r in corpus if len(plain.words(r[1])) >= 40 and plain.base_statistics(r[1])["n_repeat_words"] == 0]
    kept = corpus_pipeline.quality_rules(spark, make(spark, clean).select(COLUMNS), "").count()
    assert kept == len(clean)


def test_queries_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op")
                                               and x[2:3].isdigit()}
    assert "pipeline" in names and set(entry.oracle_sql()) <= names
