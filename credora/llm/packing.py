"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A document is its token ids and a separator. Full stretches of ``capacity`` tokens are sequences of
their own; the rest of each document is packed with others. A rest of ``t`` tokens is estimated to
cost ``linear * t + quadratic * t^2`` (attention inside a document), rests are taken by descending
length, and each goes to the lowest-cost sequence with room for it. A rest that fits nowhere any
more is cut over the lowest-cost sequences that have room left.

Rests meet in pools of about ``docs_per_pool`` documents, drawn by input row and not by any key, so
a pool is bounded and even whatever the ids, sources or copies are. A pool opens as many sequences
as its tokens need, so padding is under one sequence for each pool. Full stretches travel apart from
the rests, at most ``STRETCHES`` of a document in one group, so a long document does not fill a task.

The result holds the ids of every piece, so it is the sequences themselves; ``ids_crc32`` is derived
from that column. Pieces of one input row share its ``row``, which tells copies of a document apart.

Text is cut where white space begins after other characters, and where ASCII punctuation follows an
ASCII letter; the tokenizer's own splitting always breaks there, so equal pieces are tokenised once
and their ids repeated. The string of an added token (such as <|endoftext|>) in a text is never cut
and gets that token's id, as the tokenizer gives it; with ``special_as_text`` it is ordinary text.

Defined cases: a null or empty text is the separator alone; repeated rows are packed each; null ids
are kept; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import math
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import narrow
from .words import slices, utf8

CACHE_ENTRIES = 600_000
SLICE = 2_000_000  # bytes of text tokenised together
JOINED = 256  # pieces tokenised in one text
STRETCHES = 16  # full stretches of a document that travel in one group
FULL = 1 << 62  # ids of sequences that are one full stretch lie above those of the pools


class PieceTokenizer:
    """Token ids of white-space-led pieces, remembered within a worker process."""

    def __init__(self, path: str, special_as_text: bool):
        # Spark runs one worker for each core: threads of the tokenizer would only wait for them
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.whole = [] if special_as_text else [
            t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token
        for token, i in vocab.items():
            self.sizes[i] = len(token)  # one character of the byte alphabet for each byte
        self._clear()

    def _clear(self) -> None:
        """known: the number of each piece; its ids are flat[begin[i]:begin[i + 1]]."""
        self.known: dict[bytes, int] = {}
        self.flat, self.begin = array("I"), array("q", [0])

    def ids_of(self, pieces: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces[i] for each i in ``at``, one behind the other, and their numbers."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self._clear()
            new = pieces
        if new:
            joined, alone = [], []
            for p in new:
                (joined if self._joins(p) else alone).append(p)
            self._add_joined(joined)
            self._add(alone)
        number = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))[at]
        flat, begin = np.frombuffer(self.flat, np.uint32), np.frombuffer(self.begin, np.int64)
        begin, size = begin[number], begin[number + 1] - begin[number]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        # a copy: the arrays cannot grow while they are looked at
        return flat[np.repeat(begin - (ends - size), size) + np.arange(total)], size


    def _joins(self, piece: bytes) -> bool:
        """Whether a piece is one space, then no white space at its ends and no added token: the
        tokenizer's splitting then breaks before and after it wherever it stands."""
        if not (len(piece) > 1 and piece[0] == 0x20 and 0x20 < piece[1] < 0x7F
                and (0x20 < piece[-1] < 0x7F or piece[-2] == 0xC3)):
            return False
        for w in self.whole:
            if w in piece:
                return False
        return True

    def _add(self, pieces: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        for e in found:
            self.flat.extend(e.ids)
            self.begin.append(len(self.flat))

    def _add_joined(self, pieces: list[bytes]) -> None:
        """The same with many pieces in one text: a piece's ids end where their bytes do."""
        texts = [b"".join(pieces[i:i + JOINED]).decode() for i in range(0, len(pieces), JOINED)]
        found = [np.array(e.ids, np.uint32)
                 for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if not found:
            return
        ids = np.concatenate(found)
        bytes_until = np.cumsum(self.sizes[ids])
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        last = np.minimum(np.searchsorted(bytes_until, ends), len(ids) - 1)
        if not (bytes_until[last] == ends).all():  # a tokenizer that splits otherwise
            return self._add(pieces)
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        base = len(self.flat)
        self.flat.frombytes(ids.tobytes())
        self.begin.frombytes((base + last + 1).astype(np.int64).tobytes())


@lru_cache(maxsize=2)
def _tokenizer(path: str, special_as_text: bool) -> PieceTokenizer:
    return PieceTokenizer(path, special_as_text)


def piece_starts(data: np.ndarray, offsets: np.ndarray, whole: list[bytes] = ()) -> np.ndarray:
    """Byte offsets at which a document, a run of white space, or punctuation after a letter begins,
    but none inside a string of ``whole``."""
    space = (data <= 0x20)
    # characters that may be white space beyond ASCII: all of C2 xx, and of E1..E3 xx xx
    wide = np.zeros(len(data), dtype=bool)
    lead = data == 0xC2
    wide[1:] |= lead[:-1]
    lead = (data >= 0xE1) & (data <= 0xE3)
    wide[2:] |= lead[:-2]
    letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    mark = (data > 0x20) & (data < 0x7F) & ~letter & ~((data >= 0x30) & (data <= 0x39))
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:len(data)] = (space[1:] & ~space[:-1] & ~wide[:-1]) | (mark[1:] & letter[:-1])
    text = data.tobytes() if whole else b""
    for token in whole:
        at = text.find(token)
        while at >= 0:
            cut[at + 1:at + len(token)] = False
            at = text.find(token, at + 1)
    cut[offsets] = True
    return np.flatnonzero(cut)


def tokenise(batch: pa.RecordBatch, path: str, column: str = "text", separator: int = 0,
             special_as_text: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents of the batch, each closed by the separator, and their offsets."""
    data, offsets = utf8(batch.column(column))
    tokenizer = _tokenizer(path, special_as_text)
    starts = piece_starts(data, offsets, tokenizer.whole)
    pieces = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts) - 1,
        [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    tokens, length = tokenizer.ids_of(coded.dictionary.to_pylist(), coded.indices.to_numpy())
    ends = np.cumsum(length)
    # tokens before each document: pieces never cross documents
    first_piece = np.searchsorted(starts[:-1], offsets)
    doc_ends = np.r_[0, ends][first_piece]
    tokens = np.insert(tokens, doc_ends[1:], separator)
    return tokens, doc_ends + np.arange(len(doc_ends))


ROWS = ("doc_id {kind}, start long, length long, doc_tokens long, ids binary, row long, "
        "sequence_id long, stretch long")


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, special_as_text: bool
         ) -> Iterator[pa.RecordBatch]:
    """Full stretches (with their sequence and a group number from 1) and the rest of each document
    (group 0)."""
    row = sequence = TaskContext.get().partitionId() << 36
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            tokens, offsets = tokenise(part, path, special_as_text=special_as_text)
            sizes = np.diff(offsets)
            pieces = -(-sizes // capacity)
            at = np.repeat(np.arange(part.num_rows), pieces)
            start = (np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(sizes[at] - start, capacity)
            full = length == capacity
            begin = offsets[at] + start
            ids = [_packed(tokens[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(at)), pa.array(start), pa.array(length),
                 pa.array(sizes[at]), pa.array(ids, pa.binary()), pa.array(row + 1 + at),
                 pa.array(FULL + sequence + np.cumsum(full), mask=~full),
                 pa.array(np.where(full, 1 + start // (capacity * STRETCHES), 0))],
                names=["doc_id", "start", "length", "doc_tokens", "ids", "row", "sequence_id",
                       "stretch"])
            row += part.num_rows
            sequence += int(full.sum())


def _packed(ids: np.ndarray) -> bytes:
    """Ids as 16-bit numbers where they fit, else 32-bit, after a byte that says which."""
    small = len(ids) == 0 or int(ids.max()) < 65536
    return (b"\x02" if small else b"\x04") + ids.astype("<u2" if small else "<u4").tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if blob[0] == 2 else "<u4", offset=1).astype(np.uint32)


def _wide(ids: np.ndarray) -> bytes:
    """Ids as 32-bit numbers after the byte that says so."""
    return b"\x04" + ids.astype("<u4").tobytes()


def digest(ids: Column) -> Column:
    """crc32 of the little-endian 32-bit ids of a piece of the result."""
    return F.crc32(F.substring(ids, 2, 2 ** 31 - 1))


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float
            ) -> list[list[tuple[int, int, int, int]]]:
    """For each length (descending), its pieces (sequence, offset, start, length)."""
    n = math.ceil(sum(lengths) / capacity)
    room, cost = np.full(n, capacity), np.zeros(n)
    placed: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]

    def put(item: int, into: int, start: int, size: int) -> None:
        placed[item].append((into, capacity - int(room[into]), start, size))
        room[into] -= size
        cost[into] += linear * size + quadratic * size * size

    left = []
    for item, size in enumerate(lengths):
        fits = room >= size
        if fits.any():
            put(item, int(np.where(fits, cost, np.inf).argmin()), 0, size)
        else:
            left.append(item)
    for item in left:
        start = 0
        while start < lengths[item]:
            into = int(np.where(room > 0, cost, np.inf).argmin())
            size = min(int(room[into]), lengths[item] - start)
            put(item, into, start, size)
            start += size
    return placed


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024,
                   linear: float = 1.0, quadratic: float = 1 / 1024, docs_per_pool: int = 1024,
                   with_ids: bool = True, special_as_text: bool = True, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, the piece's ids (see
    ``unpacked``) and row (number of the input row), one row for each piece. The ids are made and
    carried always; without ``with_ids`` the finished column is left out of the result."""
    docs = narrow(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    pools = max(1, math.ceil(docs.count() / docs_per_pool))
    pieces = docs.mapInArrow(lambda it: _cut(it, tokenizer_path, capacity, special_as_text),
                             ROWS.format(kind=kind))
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "row"]

    def whole(rows: pa.Table) -> pa.Table:
        ids = [_wide(unpacked(x)) for x in rows.column("ids").to_pylist()]
        return pa.table([*[rows.column(c) for c in names[:5]],
                         pa.array(np.zeros(rows.num_rows, np.int64)), pa.array(ids, pa.binary()),
                         rows.column("row")], names)

    def pack(group: pa.Table) -> pa.Table:
        if group.column("stretch")[0].as_py():
            return whole(group)
        rests = group.sort_by([("length", "descending"), ("row", "ascending")])
        base = group.column("pool")[0].as_py() << 32
        lengths = rests.column("length").to_pylist()
        at, start, length, seq, offset, ids = [], [], [], [], [], []
        for i, parts in enumerate(balance(lengths, capacity, linear, quadratic)):
            first = rests.column("start")[i].as_py()
            own = unpacked(rests.column("ids")[i].as_py())
            for into, place, begin, size in parts:
                at.append(i)
                start.append(first + begin)
                length.append(size)
                seq.append(base + into)
                offset.append(place)
                ids.append(_wide(own[begin:begin + size]))
        rest = rests.take(pa.array(at, pa.int64()))
        return pa.table([rest.column("doc_id"), pa.array(start, pa.int64()),
                         pa.array(length, pa.int64()), rest.column("doc_tokens"),
                         pa.array(seq, pa.int64()), pa.array(offset, pa.int64()),
                         pa.array(ids, pa.binary()), rest.column("row")], names)

    out = (pieces.withColumn("pool", F.pmod(F.xxhash64("row"), F.lit(pools)))
           .groupBy("pool", "stretch").applyInArrow(
               pack, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, "
                     "offset long, ids binary, row long"))
    return out.select("doc_id", "start", "length", digest(F.col("ids")).alias("ids_crc32"),
                      "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []), "row")
