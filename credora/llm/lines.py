"""Line deduplication across documents.

Lines are normalised and exploded as 128-bit hashes, distinct documents are counted per hash, and
lines whose hash reaches the threshold are dropped everywhere; the rest is reassembled by position.
The exploded rows carry no text: each document gets back only the frequent hashes it contains, and
its lines are tested against them in one pass over the whole text.

Defined cases: a null or empty text is one empty line; empty keys (below ``min_chars``) are never
dropped; a key repeated inside one document counts once; rows that share a ``doc_id`` are one
document for the count and each row is returned; a null id is one document; an empty table gives an
empty result; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import materialise, narrow

SPACES = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def line_key(line: bytes) -> bytes:
    """A UTF-8 line with white space stripped at both ends and A-Z lower-cased."""
    return line.strip(SPACES).translate(LOWER)


def counts(key: bytes, min_chars: int) -> bool:
    """Whether a key has at least ``min_chars`` code points."""
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _line_hashes(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """One (id, hash) row for each distinct key of a document."""
    for batch in batches:
        ids, hashes = [], []
        for row, text in enumerate(texts_of(batch)):
            keys = {line_key(x) for x in text.split(b"\n")}
            found = [xxhash.xxh3_128_digest(k) for k in keys if counts(k, min_chars)]
            hashes += found
            ids += [row] * len(found)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(ids, pa.int64())), pa.array(hashes, pa.binary())],
            names=["id", "h"])


def _drop_lines(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lines, dropped = [], [], []
        for text, bad in zip(texts_of(batch), batch.column("bad").to_pylist()):
            parts = text.split(b"\n")
            kept = parts
            if bad:
                bad = set(bad)
                kept = [x for x in parts
                        if not counts(k := line_key(x), min_chars)
                        or xxhash.xxh3_128_digest(k) not in bad]
            texts.append(b"\n".join(kept))
            lines.append(len(parts))
            dropped.append(len(parts) - len(kept))
        kept_columns = batch.schema.names[:-2]  # all but text and bad
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in kept_columns],
             pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()),
             pa.array(dropped, pa.int64())],
            names=[*kept_columns, "kept_text", "n_lines", "n_dropped"])


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                   id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, h) rows of every document's distinct line keys, and the hashes found in at least
    ``min_docs`` distinct documents."""
    docs = narrow(docs, id=id_col, text=text_col)
    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.mapInArrow(lambda it: _line_hashes(it, min_chars), f"id {kind}, h binary")
    # distinct (hash, document) first: its key is spread over all tasks however hot a line is, and
    # the count per hash is then combined before its shuffle
    frequent = (rows.distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"))
                .filter(F.col("n") >= min_docs).select("h"))
    # written: its size is then known to the join, which splits a hot line's rows or broadcasts
    return rows, materialise(frequent, "lines")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None
                ) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped for every input row, and the columns of ``carry`` as a
    struct ``carried``."""
    rows, bad = frequent_lines(docs, min_docs, min_chars, id_col, text_col)
    bad = (rows.join(bad, "h", "left_semi")
           .groupBy(F.col("id").alias("bad_id")).agg(F.collect_set("h").alias("bad")))
    columns = {"id": F.col(f"`{id_col}`")}
    if carry:
        columns["carried"] = F.struct(*[F.col(f"`{c}`") for c in carry])
    texts = docs.select(*[c.alias(k) for k, c in columns.items()],
                        F.col(f"`{text_col}`").alias("text"))
    joined = (texts.join(bad, F.col("id").eqNullSafe(F.col("bad_id")), "left")
              .select(*columns, "text", "bad"))
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in columns)
    return joined.mapInArrow(lambda it: _drop_lines(it, min_chars),
                             f"{kinds}, kept_text string, n_lines long, n_dropped long") \
        .withColumnRenamed("id", "doc_id")


def drop_frequent_lines(docs: DataFrame, text_col: str = "text", **rules) -> DataFrame:
    """All rows and columns of ``docs``, its texts without the frequent lines."""
    others = [c for c in docs.columns if c != text_col]
    out = dedup_lines(docs, text_col=text_col, carry=others, **rules)
    return out.select(*[F.col("kept_text").alias(c) if c == text_col
                        else F.col(f"carried.`{c}`").alias(c) for c in docs.columns])
