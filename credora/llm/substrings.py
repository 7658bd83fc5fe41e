"""Substring deduplication: words covered by a window that an earlier document also holds.

Every window of ``n`` consecutive words gets a Rabin-Karp hash; windows are counted in Spark by
hash, and the repeated ones of a document merge into maximal removal intervals. The document with
the smallest id keeps its words. Windows are judged on the input, not on what is left.

Hashing all windows into a shuffle would move several times the text, so it runs in two rounds that
lose nothing. Each window is named after the smallest hash among its short word runs (its anchor);
equal windows have equal anchors, and one anchor serves some neighbouring windows. Round one
shuffles a document's anchors and keeps those of two or more documents; round two shuffles only
windows with such an anchor. Windows are compared by 80 bits of two independent hashes.

Frequent passages: inside a slice of the input a window's later holders are settled at once (the
earliest one is at hand), so only one row for each slice goes to the task of a hot window.

Defined cases: ids are integers; a null id stands after all others, and such rows are one document;
rows with one id never remove each other's words; a null text has no words; a text of fewer than
``n`` words loses nothing; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import materialise, narrow
from .words import Words, mix, slices, words_of

NO_ID = 2 ** 63 - 1
MAX_RUN = 5
WORD_SEED, WINDOW_SEED, RUN_SEED, WORD_SEED2, WINDOW_SEED2 = 1, 2, 3, 4, 5
LOW16, SETTLED = np.uint64(0xFFFF), -2 ** 63

REMOVED = ("id long, n_words long, n_removed long, kept_text string, "
           "intervals array<struct<begin:int,end:int>>")


def _runs(changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First indices of the runs that start where ``changed``, and each element's run."""
    return np.flatnonzero(changed), np.cumsum(changed) - 1


def _changes(*keys: np.ndarray) -> np.ndarray:
    changed = np.ones(len(keys[0]), dtype=bool)
    changed[1:] = False
    for k in keys:
        changed[1:] |= k[1:] != k[:-1]
    return changed


def _anchors_of(words: Words, n: int, hashes: np.ndarray) -> np.ndarray:
    """For each window of the slice, the smallest hash of the short runs in it."""
    k = min(MAX_RUN, n)
    runs = words.windows(hashes, k, RUN_SEED)
    count = max(0, len(hashes) - n + 1)
    best = runs[:count].copy()
    for j in range(1, n - k + 1):
        np.minimum(best, runs[j:j + count], out=best)
    return best


def _spread(key: np.ndarray, settled: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The shuffle key: the hash itself, or for settled rows something that spreads them."""
    return np.where(settled, mix(ids.astype(np.uint64) ^ key), key).view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(key, id, anchor): a document's distinct anchors. An anchor that two documents of the slice
    have is known to be shared and stands in the third column, else that is null."""
    for batch in batches:
        for part in slices(batch, "text"):
            ids, rows = part.column("id").to_numpy(), part.column("row").to_numpy()
            words = words_of(part, "text")
            at = words.valid(n)
            anchor = _anchors_of(words, n, words.hashes(WORD_SEED))[at]
            doc = words.doc_of(at)
            owner, row = ids[doc], rows[doc]
            order = np.lexsort((row, owner, anchor))
            anchor, owner, row = anchor[order], owner[order], row[order]
            keep = _changes(anchor, owner, row)
            anchor, owner, row = anchor[keep], owner[keep], row[keep]
            changed = _changes(anchor)
            _, run = _runs(changed)
            # rows of one id are one document, but each asks for its own anchors
            documents = np.bincount(run, _changes(anchor, owner), minlength=1)
            several = documents[run] > 1 if len(run) else changed
            # the first holder stands for the slice, the others are known to share the anchor
            settled = several & ~changed
            yield pa.RecordBatch.from_arrays(
                [pa.array(_spread(anchor, settled, owner)), pa.array(owner), pa.array(row),
                 pa.array(anchor.view(np.int64), mask=~several)], names=["key", "id", "row", "anchor"])


def _window_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(key, id, place): a document's distinct windows with a shared anchor. place: first word and
    16 bits of the second hash; negative if an earlier holder is in the slice."""
    for batch in batches:
        for part in slices(batch, "text"):
            ids, rows = part.column("id").to_numpy(), part.column("row").to_numpy()
            words = words_of(part, "text")
            shared = np.unique(part.column("anchors").flatten().to_numpy())
            hashes = words.hashes(WORD_SEED)
            at = words.valid(n)
            at = at[np.isin(_anchors_of(words, n, hashes)[at].astype(np.uint32).view(np.int32),
                            shared)]
            first, second = _window_keys(words, hashes, n)
            first, second, doc = first[at], second[at], words.doc_of(at)
            place = ((at - words.first[doc]) << 16) | second.astype(np.int64)
            order = np.lexsort((at, doc, second, first))
            first, second, doc, place = first[order], second[order], doc[order], place[order]
            keep = _changes(first, second, doc)
            first, second, doc, place = first[keep], second[keep], doc[keep], place[keep]
            owner, row = ids[doc], rows[doc]
            begin, run = _runs(_changes(first, second))
            least = np.minimum.reduceat(owner, begin) if len(begin) else owner
            settled = owner > least[run] if len(run) else np.empty(0, dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_spread(first, settled, owner)), pa.array(owner), pa.array(row),
                 pa.array(np.where(settled, place | SETTLED, place))], names=["key", "id", "row", "place"])


def _window_keys(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    second = words.windows(words.hashes(WORD_SEED2), n, WINDOW_SEED2) & LOW16
    return words.windows(hashes, n, WINDOW_SEED), second


def _remove(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = words_of(part, "text")
            gone = _covered(words, part.column("places"), n)
            yield _kept(part.column("id"), words, gone)


def _covered(words: Words, places: pa.Array, n: int) -> np.ndarray:
    """Marks of the words under a window that equals one of its document's removed windows."""
    size = len(words.starts)
    marks = np.zeros(size + 1, dtype=np.int64)
    listed = np.diff(places.offsets.to_numpy())
    if listed.sum() == 0:
        return np.zeros(size, dtype=bool)
    hashes = words.hashes(WORD_SEED)
    first, second = _window_keys(words, hashes, n)
    doc = np.repeat(np.arange(len(listed)), listed)
    place = places.flatten().to_numpy() & ~SETTLED
    at = words.first[doc] + (place >> 16)
    # a place of another row with the same id and another text does not hold these words
    inside = at + n <= words.first[doc + 1]
    doc, place, at = doc[inside], place[inside], at[inside]
    at = at[second[at] == (place & 0xFFFF).astype(np.uint64)]
    # other windows of the document with the same words: the removed one was listed once
    valid = words.valid(n)
    name = first ^ mix((second << np.uint64(32)) | words.doc_of(np.arange(len(first))).astype(np.uint64))
    hit = valid[np.isin(name[valid], name[at])]
    np.add.at(marks, hit, 1)
    np.add.at(marks, hit + n, -1)
    return np.cumsum(marks[:-1]) > 0


def _kept(ids: pa.Array, words: Words, gone: np.ndarray) -> pa.RecordBatch:
    first, docs = words.first, len(words.first) - 1
    doc = np.repeat(np.arange(docs), words.counts)
    kept = np.flatnonzero(~gone)
    removed = np.bincount(doc[gone], minlength=docs)
    # bytes of the kept words, each but a document's last with the separator behind it
    last = np.ones(len(kept), dtype=bool)
    last[:-1] = doc[kept[1:]] != doc[kept[:-1]]
    begin, end = words.starts[kept], words.ends[kept] + ~last
    marks = np.zeros(len(words.data) + 1, dtype=np.int8)
    np.add.at(marks, begin, 1)
    np.add.at(marks, end, -1)
    text = words.data.copy()
    text[np.minimum(words.ends[kept[~last]], max(len(text) - 1, 0))] = 0x20
    text = text[np.cumsum(marks[:-1], dtype=np.int8) > 0]
    sizes = np.bincount(doc[kept], weights=end - begin, minlength=docs).astype(np.int64)
    offsets = np.zeros(docs + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    # maximal runs of removed words inside one document
    own = np.arange(len(doc)) - first[:-1][doc]
    opens = gone & (np.r_[True, ~gone[:-1] | (doc[1:] != doc[:-1])] if len(gone) else gone)
    closes = gone & (np.r_[~gone[1:] | (doc[1:] != doc[:-1]), True] if len(gone) else gone)
    spans = pa.StructArray.from_arrays(
        [pa.array(own[opens], pa.int32()), pa.array(own[closes] + 1, pa.int32())],
        names=["begin", "end"])
    span_offsets = np.zeros(docs + 1, dtype=np.int32)
    np.cumsum(np.bincount(doc[opens], minlength=docs), out=span_offsets[1:])
    texts = pa.LargeStringArray.from_buffers(docs, pa.py_buffer(offsets), pa.py_buffer(text))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()),
         texts.cast(pa.string()), pa.ListArray.from_arrays(span_offsets, spans)],
        names=["id", "n_words", "n_removed", "kept_text", "intervals"])


def dedup_substrings(docs: DataFrame, n: int = 13, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space) and intervals (removed
    words, begin included, end not) for every input row."""
    docs = narrow(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    # rows that share an id are told apart by their texts, so that none is joined with another's lists;
    # written: where no id repeats, the join sees an empty table
    repeated_ids = materialise(texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                               .select(F.col("id").alias("r_id")), "substrings-ids", files=64)
    texts = texts.join(repeated_ids, F.col("id") == F.col("r_id"), "left").select(
        "id", F.when(F.col("r_id").isNotNull(), F.xxhash64("text")).otherwise(0).alias("row"), "text")
    anchors = texts.mapInArrow(lambda it: _anchor_rows(it, n), "key long, id long, row long, anchor long")
    # a slice's settled rows are spread; its first holder meets those of other slices here
    same_key = Window.partitionBy("key")
    shared = (anchors.withColumn("low", F.min("id").over(same_key))
              .withColumn("high", F.max("id").over(same_key))
              .filter(F.col("anchor").isNotNull() | (F.col("low") < F.col("high")))
              .groupBy(*_owner("s")).agg(F.collect_set(_low32(F.coalesce("anchor", "key"))).alias("anchors")))
    # both joins with the texts use the same exchange
    windows = (texts.join(shared, _same_row("s")).select("id", "row", "text", "anchors")
               .mapInArrow(lambda it: _window_rows(it, n), "key long, id long, row long, place long"))
    # the second hash is part of the window's name but not of the shuffle key
    same_window = Window.partitionBy("key", "part")
    repeated = (windows.repartition("key")
                .withColumn("part", F.col("place").bitwiseAND(0xFFFF))
                .withColumn("low", F.min("id").over(same_window))
                .filter((F.col("place") < 0) | (F.col("low") < F.col("id")))
                .groupBy(*_owner("w")).agg(F.collect_set("place").alias("places")))
    return (texts.join(repeated, _same_row("w"), "left")
            .select("id", "text", F.coalesce("places", F.array().cast("array<long>")).alias("places"))
            .mapInArrow(lambda it: _remove(it, n), REMOVED)
            .select(F.nullif("id", F.lit(NO_ID)).cast(kind).alias("doc_id"), "n_words", "n_removed",
                    "kept_text", "intervals"))


def _owner(prefix: str) -> list[Column]:
    return [F.col("id").alias(f"{prefix}_id"), F.col("row").alias(f"{prefix}_row")]


def _same_row(prefix: str) -> Column:
    return (F.col("id") == F.col(f"{prefix}_id")) & (F.col("row") == F.col(f"{prefix}_row"))


def _low32(value: Column) -> Column:
    """The low 32 bits of a long as a signed int."""
    low = value.bitwiseAND(0xFFFFFFFF)
    return F.when(low >= 2 ** 31, low - 2 ** 32).otherwise(low).cast("int")
