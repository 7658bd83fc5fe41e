"""BPE encoding and decoding against the tokenizers library, and the automaton against a dictionary."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from credora.llm import bpe

from .conftest import make

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "Hello, WORLD's 123 don't I'LL  x", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>c<|endoftext",
       "ΣΑΣ ΟΔΟΣ İstanbul ǅ", "é ño ạ̈", "中文字 テスト 한국어 \U0001F600\U0001F601!!",
       "tab\there\x0bline\nend\x85\xa0 ​.", "x" * 3000, "ab1c2" * 700, "ᲉꟋ \U000105c0 ՘", "…—“quotes”'S 'Re",
       "word " * 2000 + "!" * 500]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def encoded(df, **rules):
    out = bpe.decode_documents(bpe.encode_documents(df, PATH, **rules), PATH)
    return sorted((((r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in out.collect()),
                  key=repr)


def expected(rows, tokenizer):
    out = []
    for d, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        out.append((d, ids, tokenizer.decode(ids, skip_special_tokens=False)))
    return sorted(out, key=repr)


def odd_texts():
    rng = random.Random(5)
    texts = [(i, t, "en", "s") for i, t in enumerate(ODD)]
    for i in range(60):
        texts.append((100 + i, "".join(rng.choice("ab'sS1é.ßÉ \ń<|>") for _ in range(rng.randint(0, 80))), "en", "s"))
    return texts


@pytest.mark.parametrize("max_words", [bpe.MAX_WORDS, 10, 0])
def test_equals_library(spark, corpus, tokenizer, max_words):
    rows = corpus + [(1000 + d, *rest) for d, *rest in odd_texts()]
    assert encoded(make(spark, rows), max_words=max_words) == expected(rows, tokenizer)


def test_odd_and_empty(spark, odd, odd_rows, no_docs, tokenizer):
    assert encoded(odd) == expected(odd_rows, tokenizer)
    assert encoded(no_docs) == []


def test_long_texts_in_parts(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "PART_CHARS", 40)
    merges = bpe.merges_of(PATH)
    for _, text, *_ in odd_texts():
        parts = list(bpe._parts(text))
        assert "".join(parts) == text
        ids = [i for p in parts for w in merges.split(p) for i in merges.ids(w)]
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_automaton_is_minimal_and_exact(tmp_path):
    rng = random.Random(2)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))).encode() for _ in range(600)}
    words |= {w + b"ing" for w in list(words)[:200]} | {b"\xff\x00", b"\x00"}
    entries = [(w, [rng.randrange(50_000) for _ in range(rng.randint(1, 4))]) for w in words]
    path = tmp_path / "lexicon.bin"
    path.write_bytes(bpe.compile_lexicon(entries).to_bytes())
    lexicon = bpe.Lexicon.mapped(str(path))
    probes = sorted(words) + [w + b"x" for w in words] + [w[:-1] for w in words] + [b""]
    rows = lexicon.rows(np.frombuffer(b"".join(probes), np.uint8), np.cumsum([0, *map(len, probes)]))
    ids = dict(entries)
    for w, row in zip(probes, rows.tolist()):
        assert (row >= 0) == (w in ids)
        if row >= 0:
            assert lexicon.ids[lexicon.begin[row]:lexicon.begin[row + 1]].tolist() == ids[w]
    # one state for each distinct set of endings
    endings = {}
    for w in words:
        for k in range(len(w) + 1):
            endings.setdefault(w[:k], set()).add(w[k:])
    assert len(lexicon.final) == len({frozenset(e) for e in endings.values()})
    assert len(lexicon.final) < len(endings) / 2  # fewer than a trie without shared suffixes
    empty = bpe.compile_lexicon([])
    assert empty.rows(np.frombuffer(b"ab", np.uint8), np.array([0, 2])).tolist() == [-1]


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.Merges(public_tokenizers.path("byte_bpe_50k.json"))
