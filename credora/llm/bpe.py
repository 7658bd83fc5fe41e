"""BPE encoding and decoding with a lexicon of frequent words in a minimal acyclic transducer.

The tokenizer file (the ``tokenizers`` library's JSON) names added tokens, NFC and lower-casing, the
pattern of words, the byte alphabet, the vocabulary and the ranked merges. Words are counted over all
documents in Spark; the frequent ones (at most ``max_words``, of at most ``WORD_BYTES`` bytes) are merged
in tasks and compiled on the driver into one automaton: equal suffixes share their states, and
transitions carry integer outputs whose sum along a word's path is the word's row in a table of id
sequences. The file is written to the shared scratch folder, handed out by Spark (``addFile``) and
memory-mapped by the workers of an executor, which walk it for all distinct words of a slice at once.
Words that are not in it are merged exactly, lowest rank first and leftmost among equals, so the
lexicon's bound changes the speed only and never an id.

Decoding joins the tokens' strings with one space, as the library does for a file without a decoder.

Defined cases: a null or empty text has no ids and decodes to the empty string; null ids of documents and
repeated rows are kept; an empty table gives an empty result; other input columns are ignored. Long
texts are cut before white space, which no word contains, and words may have any length.
"""

from __future__ import annotations

import heapq
import json
import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credora.session import scratch_path

from .frames import materialise, narrow
from .words import slices, utf8

MAX_WORDS = 1 << 18
WORD_BYTES = 48
PART_CHARS = 1_000_000   # characters of a text encoded at once
KNOWN_WORDS = 100_000    # words outside the lexicon that a worker remembers
FLUSH = 200_000          # distinct words a counting task holds
SHORT = 24               # longer words are merged with a heap
NO_RANK = 1 << 62
LOW32 = (1 << 32) - 1
ADDED = " "              # marks added tokens among the words, which hold no white space
ASTRAL = re.compile("[\U00010000-\U0010ffff]")
BREAKS = regex.compile(r"[ \n\t\r]")


# ---- the tokenizer file -----------------------------------------------------------------------

def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte value."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Merges:
    """Words of a text and their ids, straight from the tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], [s["type"] for s in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if (model["type"], steps, split["type"], split["behavior"], split["invert"], level["type"],
                level["add_prefix_space"], level["use_regex"], spec["post_processor"], spec["decoder"]) != (
                "BPE", ["NFC", "Replace", "Lowercase"], "Split", "Removed", True, "ByteLevel", False,
                False, None, None):
            raise ValueError(f"{path}: not a lower-casing word BPE over bytes without a decoder")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pattern = split["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        # the same pattern for lower-case ASCII text, for the faster engine
        self.ascii_words = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(
            self.added, key=len, reverse=True)) + ")") if self.added else None
        self.path, self.library = path, None
        alphabet = byte_alphabet()
        self.byte = {c: b for b, c in enumerate(alphabet)}
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + suffix] for c in alphabet]
        self.rank = {}
        for i, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.rank[vocab[a] << 32 | vocab[b]] = i << 32 | vocab[a + b]
        strings = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in [*vocab.items(), *self.added.items()]:
            strings[i] = token
        self.strings = pa.array(strings, pa.large_string())

    def split(self, text: str) -> list[str]:
        """The words of a text; added tokens behind ``ADDED``."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        out = []
        for part in self.special.split(text):
            out += [ADDED + part] if part in self.added else self.plain(part)
        return out

    def plain(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        if not has_newer_characters(text):
            return self.words.findall(_normal(text))
        # classes of these characters depend on the library's own Unicode version
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.byte[c] for c in p).decode() for p, _ in pieces]

    def ids(self, word: str) -> list[int]:
        """A word's ids: the adjacent pair of the lowest rank is merged, the leftmost first, until no
        pair has a rank."""
        if word[0] == ADDED:
            return [self.added[word[1:]]]
        data = word.encode()
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        return self._merged(ids) if len(ids) <= SHORT else self._merged_long(ids)

    def _merged(self, ids: list[int]) -> list[int]:
        rank = self.rank.get
        ranks = [rank(a << 32 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != NO_RANK:
            i, new = ranks.index(low), low & LOW32
            ids[i] = new
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(new << 32 | ids[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | new, NO_RANK)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs and links between the ids that are left."""
        rank, end = self.rank, len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = []

        def push(i: int, j: int) -> None:
            if i >= 0 and j < end and (low := rank.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (low, i, ids[i], ids[j]))

        for i in range(end - 1):
            push(i, i + 1)
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else end
            if j >= end or ids[j] != b:
                continue  # one side was merged with another neighbour meanwhile
            ids[i], ids[j] = low & LOW32, -1
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            push(i, after[i])
            push(before[i], i)
        return [x for x in ids if x >= 0]


@lru_cache(maxsize=1)
def newer_characters() -> tuple[re.Pattern, re.Pattern]:
    """Characters that the pattern engine has a class for and Python's Unicode tables have not: those of
    16 bits, and the others."""
    newer, assigned = [], regex.compile(r"\P{Cn}")
    for c in filter(lambda c: unicodedata.category(c) == "Cn", map(chr, range(0x110000))):
        if assigned.match(c):
            newer.append(c)
    parts = "".join(c for c in newer if c <= "\uffff"), "".join(c for c in newer if c > "\uffff")
    return tuple(re.compile(f"[{p}]" if p else r"(?!)") for p in parts)


def has_newer_characters(text: str) -> bool:
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        small, large = newer_characters()
        return bool(small.search(text) or any(large.match(c) for c in set(ASTRAL.findall(text))))


def _normal(text: str) -> str:
    """NFC and lower case of each character; runs of white space are left, as no word holds any."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final sigma


@lru_cache(maxsize=4)
def merges_of(path: str) -> Merges:
    return Merges(path)


# ---- the transducer ---------------------------------------------------------------------------

class Lexicon:
    """Words -> id sequences: a minimal acyclic automaton with integer outputs, over flat arrays.

    bits[4 s + k]: which of the bytes 64 k .. 64 k + 63 leave state s; first[4 s + k]: the number of the
    first of these transitions; target, output: of each transition; final: of each state. The outputs
    on a word's path sum up to its row, whose ids are ids[begin[row]:begin[row + 1]]."""

    NAMES = ("bits", "first", "target", "output", "final", "begin", "ids")
    KINDS = ("<u8", "<i4", "<i4", "<i4", "u1", "<i8", "<i4")

    def __init__(self, *arrays: np.ndarray):
        for name, a in zip(self.NAMES, arrays):
            setattr(self, name, a)

    def to_bytes(self) -> bytes:
        arrays = [np.ascontiguousarray(getattr(self, n), k) for n, k in zip(self.NAMES, self.KINDS)]
        head = np.array([a.nbytes for a in arrays], "<i8").tobytes()
        return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """The automaton of a file, memory-mapped."""
        data = np.memmap(path, np.uint8, "r")
        at, arrays = 8 * len(cls.NAMES), []
        for size, kind in zip(data[:at].view("<i8").tolist(), cls.KINDS):
            arrays.append(data[at:at + size].view(kind))
            at += size + (-size % 8)
        return cls(*arrays)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The row of each word data[offsets[i]:offsets[i + 1]], or -1."""
        n = len(offsets) - 1
        out = np.full(n, -1)
        at, size = offsets[:-1], np.diff(offsets)
        word = np.flatnonzero(size > 0)
        state, total = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        step = 0
        while len(word):
            byte = data[at[word] + step]
            part = 4 * state + (byte >> 6)
            bits, low = self.bits[part], (byte & 63).astype(np.uint64)
            there = (bits >> low) & np.uint64(1) == 1
            word, part, bits, low, total = word[there], part[there], bits[there], low[there], total[there]
            edge = self.first[part] + np.bitwise_count(bits & ((np.uint64(1) << low) - np.uint64(1)))
            state, total = self.target[edge].astype(np.int64), total + self.output[edge]
            step += 1
            ended = size[word] == step
            good = ended & (self.final[state] == 1)
            out[word[good]] = total[good]
            word, state, total = word[~ended], state[~ended], total[~ended]
        return out


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> Lexicon:
    """The minimal automaton of the words, which are added in byte order: the states of the last word's
    path are open, and a state is closed (replaced by an equal closed one, if there is one) as soon as
    the next word leaves it."""
    entries = sorted(entries)
    known: dict[tuple, int] = {}
    states: list[tuple] = []             # closed states: (final, ((byte, target), ...))
    path: list[list] = [[0, []]]         # open states: [final, [(byte, closed target), ...]]

    def close(down_to: int) -> None:
        while len(path) > down_to + 1:
            final, edges = path.pop()
            key = (final, tuple(edges))
            if key not in known:
                known[key] = len(states)
                states.append(key)
            path[-1][1][-1] = (path[-1][1][-1][0], known[key])

    before = b""
    for word, _ in entries:
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        close(same)
        for b in word[same:]:
            path[-1][1].append((b, -1))
            path.append([0, []])
        path[-1][0] = 1
        before = word
    close(0)
    states.append((path[0][0], tuple(path[0][1])))

    # the root becomes state 0; targets were closed before the states that point at them
    order = [len(states) - 1, *range(len(states) - 1)]
    number = {old: new for new, old in enumerate(order)}
    accepted = [0] * len(states)
    for old, (final, edges) in enumerate(states):
        accepted[old] = final + sum(accepted[t] for _, t in edges)
    n = len(states)
    bits, first, final = np.zeros(4 * n, np.uint64), np.zeros(4 * n, np.int64), np.zeros(n, np.uint8)
    target, output = [], []
    for new, old in enumerate(order):
        final[new], edges = states[old]
        passed = int(final[new])
        first[4 * new:4 * new + 4] = [len(target) + sum(b < 64 * k for b, _ in edges) for k in range(4)]
        for b, t in edges:
            bits[4 * new + (b >> 6)] |= np.uint64(1 << (b & 63))
            target.append(number[t])
            output.append(passed)
            passed += accepted[t]
    ids = [x for _, x in entries]
    return Lexicon(bits, first, np.array(target, np.int64), np.array(output, np.int64), final,
                   np.cumsum([0, *map(len, ids)]), np.array([i for x in ids for i in x], np.int64))


@lru_cache(maxsize=2)
def _mapped(name: str) -> Lexicon:
    return Lexicon.mapped(SparkFiles.get(name))


# ---- words of the corpus ----------------------------------------------------------------------

def _parts(text: str) -> Iterator[str]:
    """A text in parts of about ``PART_CHARS`` characters, cut before white space."""
    at = 0
    while len(text) - at > PART_CHARS:
        cut = BREAKS.search(text, at + PART_CHARS)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()),
                                           pa.array(counts.values(), pa.int64())], names=["word", "n"])

    split, counts = merges_of(path).split, Counter()
    for batch in batches:
        for text in batch.column("text"):
            for part in _parts(text.as_py() or ""):
                counts.update(split(part))
                if len(counts) > FLUSH:
                    yield rows()
                    counts.clear()
    yield rows()


def _merge(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    ids = merges_of(path).ids
    for batch in batches:
        found = [ids(w) for w in batch.column("word").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(found, pa.list_(pa.int32()))],
                                         names=["word", "ids"])


def build_lexicon(docs: DataFrame, tokenizer_path: str, max_words: int = MAX_WORDS, text_col: str = "text"
                  ) -> str:
    """Name of the file (see ``SparkFiles``) with the lexicon of the documents' frequent words."""
    docs = narrow(docs, text=text_col)
    words = docs.mapInArrow(lambda it: _count(it, tokenizer_path), "word string, n long")
    # by classes of counts, an eighth of a doubling wide: no sort, and only whole classes are taken
    words = materialise(
        words.filter(F.octet_length("word") <= WORD_BYTES).groupBy("word").agg(F.sum("n").alias("n"))
        .filter("n > 1").withColumn("class", F.floor(F.log2("n") * 8)), "bpe-words")
    least, taken = math.inf, 0
    for r in sorted(words.groupBy("class").count().collect(), reverse=True):
        taken += r["count"]
        if taken > max_words:
            break
        least = r["class"]
    rows = (words.filter(F.col("class") >= F.lit(float(least))).select("word")
            .mapInArrow(lambda it: _merge(it, tokenizer_path), "word string, ids array<int>").collect())
    lexicon = compile_lexicon([(r["word"].encode(), r["ids"]) for r in rows])
    return _hand_out(docs.sparkSession, lexicon.to_bytes())


def _hand_out(spark: SparkSession, data: bytes) -> str:
    """Write a file to the shared scratch folder and have Spark bring it to every executor."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'bpe')}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


# ---- encoding and decoding --------------------------------------------------------------------

def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[b:b + s] for each pair, one behind the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begin - (ends - size), size) + np.arange(total)]


class Encoder:
    def __init__(self, path: str, name: str):
        self.merges, self.lexicon = merges_of(path), _mapped(name)
        self.known: dict[str, list[int]] = {}

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one behind the other, and each word's number of ids."""
        row = self.lexicon.rows(*utf8(words))
        unseen = np.flatnonzero(row < 0)
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        made = []
        for w in words.take(pa.array(unseen)).to_pylist():
            ids = self.known.get(w)
            if ids is None:
                ids = self.merges.ids(w)
                if len(w) <= WORD_BYTES:
                    self.known[w] = ids
            made.append(ids)
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        seen = np.flatnonzero(row >= 0)
        row = row[seen]
        size[seen] = self.lexicon.begin[row + 1] - self.lexicon.begin[row]
        size[unseen] = [len(x) for x in made]
        own = _gather(self.lexicon.ids, self.lexicon.begin[row], size[seen])
        flat = np.concatenate([own, np.array([i for x in made for i in x], np.int32)]).astype(np.uint32)
        begin[seen] = np.cumsum(size[seen]) - size[seen]
        begin[unseen] = len(own) + np.cumsum(size[unseen]) - size[unseen]
        return _gather(flat, begin, size), size

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        lists = [self.merges.split(t) for t in texts]
        coded = pa.array([w for x in lists for w in x], pa.string()).dictionary_encode()
        flat, size = self.words(coded.dictionary)
        at = coded.indices.to_numpy()
        begin = np.cumsum(size) - size
        ids = _gather(flat, begin[at], size[at]).astype("<u4").tobytes()
        ends = np.r_[0, np.cumsum(size[at])][np.cumsum([0, *map(len, lists)])] * 4
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


@lru_cache(maxsize=2)
def _encoder(path: str, name: str) -> Encoder:
    return Encoder(path, name)


def _encode(batches: Iterator[pa.RecordBatch], path: str, name: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path, name)
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            if sum(map(len, texts)) <= 2 * PART_CHARS:
                ids = encoder.texts(texts)
            else:
                ids = [b"".join(encoder.texts([p])[0] for p in _parts(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())],
                                             names=["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    strings = merges_of(path).strings
    for batch in batches:
        for part in slices(batch, "ids"):
            data, ends = bytes_of(part.column("ids"))
            tokens = strings.take(pa.array(data.view("<u4")))
            lists = pa.LargeListArray.from_arrays(pa.array(ends // 4), tokens)
            text = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, text.cast(pa.string())], names=[*part.schema.names, "decoded"])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; null is empty."""
    column = pc.fill_null(column, b"").cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return np.ascontiguousarray(data[offsets[0]:offsets[-1]]), offsets - offsets[0]


def encode_documents(docs: DataFrame, tokenizer_path: str, max_words: int = MAX_WORDS,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit numbers) for every input row."""
    name = build_lexicon(docs, tokenizer_path, max_words, text_col)
    docs = narrow(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lambda it: _encode(it, tokenizer_path, name), f"doc_id {kind}, ids binary")


def decode_documents(coded: DataFrame, tokenizer_path: str) -> DataFrame:
    """The columns of ``coded`` (doc_id, ids) and ``decoded``: the tokens' strings joined by one space."""
    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "ids").mapInArrow(
        lambda it: _decode(it, tokenizer_path), f"doc_id {kind}, ids binary, decoded string")


def n_tokens(ids: Column) -> Column:
    return F.shiftright(F.octet_length(ids), 2).cast("long")
