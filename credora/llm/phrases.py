"""Phrase collocations from one count of padded longest windows and a ROLLUP over their prefixes.

Every word begins exactly one window: the word and the next ``longest - 1`` words of its piece (its lead
columns), padded where the piece ends. A phrase occurs as often as windows begin with it, so only the
longest windows are counted, and Spark's ROLLUP over the window columns sums them to every shorter
prefix; n-grams of other lengths are never exploded.

Windows are counted in two steps. A slice of a task's texts counts its own windows with NumPy, so a hot
phrase is counted once for each slice. The windows go to buckets by their first word, those of a slice and a
bucket in one row, and a bucket sums them. There a
window is padded behind its longest prefix that occurs ``min_count`` times (shorter windows still count for
their own prefixes), so the ROLLUP gets frequent phrases and single words only. First words, and pairs of
first words, with a large share of the windows would fill one bucket: they are dealt to many buckets by the
words that follow, and their totals are summed by the ROLLUP. Which ones these are is estimated on a bounded
sample of documents; the estimate decides where rows go and never what is counted.

Scores are exact: decimals hold products of counts up to 10^15 times a million.

Defined cases: a null text is empty, a null language is ``und``; repeated rows and documents of one id
count each; an empty table gives an empty result; other input columns are ignored. Pieces, words and
texts may have any length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import materialise, narrow
from .words import mix, run_hash, slices, utf8

BUCKET_BYTES = 4_000_000    # text for each bucket of windows
SLICE = 1_000_000           # bytes of text whose windows are counted together
SAMPLE_ROWS = 5_000         # documents on which hot words are estimated
HOT = 1000                  # a share of 1 / HOT of the windows makes a word or pair hot
SPREAD = 128                # buckets of a hot word, and of a hot pair
RANK_SALTS = 64
HASH_SEED = 11

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09]] = True
END = np.zeros(256, bool)
END[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, *range(0x0A, 0x0E)]] = True  # . , ; : ! ? and \n to \r


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all texts, and the number of each word's piece."""
    data, offsets = utf8(column)
    data = LOWER[data]
    end = END[data]
    word = ~(SPACE[data] | end)
    # a text's first byte begins a word and a piece of its own
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets[:-1]] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | fresh[1:-1]
    starts = np.flatnonzero(start)
    piece = np.cumsum(end | fresh[:-1])[starts]
    letters = data[word]
    begin = np.cumsum(word)[starts] - 1 if len(starts) else starts
    bounds = np.r_[begin, len(letters)].astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]), piece


def _runs(columns: list[np.ndarray], base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of code columns (each below ``base``), sorted, and their numbers of occurrences."""
    bits = base.bit_length()
    if bits * len(columns) > 63:
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        at = np.flatnonzero(new)
        return [c[at] for c in columns], np.diff(np.r_[at, len(order)])
    key = columns[0]
    for c in columns[1:]:
        key = key << bits | c
    key = np.sort(key)
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
    count, key = np.diff(np.r_[at, len(key)]), key[at]
    mask = (1 << bits) - 1
    return [key >> bits * (len(columns) - 1 - i) & mask for i in range(len(columns))], count


def _windows(batch: pa.RecordBatch, longest: int) -> tuple[list[np.ndarray], np.ndarray, pa.Array]:
    """Distinct windows as code columns (0: padding, code c: word c - 1), their counts and the words."""
    words, piece = _words(batch.column("text"))
    coded = words.dictionary_encode()
    first = coded.indices.to_numpy().astype(np.int64) + 1
    columns, inside = [first], np.ones(len(first), bool)
    for k in range(1, longest):
        lead, inside = np.zeros(len(first), np.int64), inside.copy()
        inside[len(first) - k:] = False
        inside[:len(first) - k] &= piece[k:] == piece[:len(first) - k]
        lead[:len(first) - k] = np.where(inside[:len(first) - k], first[k:], 0)
        columns.append(lead)
    columns, count = _runs(columns, len(coded.dictionary) + 1)
    return columns, count, coded.dictionary


def _hashes(words: pa.Array, lang: str) -> np.ndarray:
    """A hash of each word in its language; at 0 that of the padding."""
    data, offsets = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.frombuffer(words.buffers()[1], np.int64)
    own = run_hash(data.astype(np.uint64) + np.uint64(1), offsets[:-1], offsets[1:], HASH_SEED)
    return mix(np.r_[np.uint64(0), own] ^ np.uint64(zlib.crc32(lang.encode())))


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(3) + b)


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            own = batch.filter(pc.equal(langs.indices, i)) if len(langs.dictionary) > 1 else batch
            for part in slices(own, "text", SLICE):
                yield lang, part


def _count(batches: Iterator[pa.RecordBatch], longest: int, buckets: int, hot_words: np.ndarray,
           hot_pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, split, phrases, n): the windows of each slice, those of a bucket in one row as lines of
    words joined by a space, with their counts. split: the first two words are dealt to several buckets."""
    for lang, part in _by_lang(batches):
        columns, count, words = _windows(part, longest)
        h = _hashes(words, lang)
        key = h[columns[0]]
        split = np.zeros(len(count), bool)
        if longest > 1:
            second = h[columns[1]]
            pair = _pair(key, second)
            split = np.isin(pair, hot_pairs) if longest > 2 else split
            key = np.where(np.isin(key, hot_words), _pair(key, second % np.uint64(SPREAD)), key)
        if longest > 2:
            key = np.where(split, _pair(pair, h[columns[2]] % np.uint64(SPREAD)), key)
        place = (key % np.uint64(buckets)).astype(np.int64) * 2 + split
        order = np.argsort(place, kind="stable")
        place = place[order]
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else order
        words = words.cast(pa.large_string())
        columns = [c[order] for c in columns]
        parts = [words.take(pa.array(c - 1, mask=c == 0)) for c in columns]
        phrase = pc.binary_join_element_wise(*parts, _text(" "), null_handling="skip")
        bounds = np.r_[first, len(order)]
        lines = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), phrase), _text("\n"))
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(first), pa.string()), pa.array(place[first] >> 1), pa.array(place[first] & 1 == 1),
             lines.cast(pa.string()),
             pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(count[order], pa.int32()))],
            names=["lang", "bucket", "split", "phrases", "n"])


def _hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, h, n): hashes of the first words and pairs of a sample's windows."""
    for lang, part in _by_lang(batches):
        columns, count, words = _windows(part, 2)
        h = _hashes(words, lang)
        first, second = h[columns[0]], h[columns[1]]
        for pair, keys in ((False, first), (True, _pair(first, second)[columns[1] > 0])):
            n = count[columns[1] > 0] if pair else count
            own, at = np.unique(keys, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own), pair)), pa.array(own.view(np.int64)),
                 pa.array(np.bincount(at, n, len(own)).astype(np.int64))], names=["pair", "h", "n"])


def hot_keys(docs: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of the pairs that begin at least 1 / ``HOT`` of the windows of a sample of
    about ``SAMPLE_ROWS`` documents: at most ``HOT`` of each."""
    sample = docs.sample(min(1.0, SAMPLE_ROWS / max(rows, 1)), seed=13)
    found = sample.mapInArrow(_hot, "pair boolean, h long, n long").groupBy("pair", "h").agg(F.sum("n").alias("n"))
    sums = found.groupBy("pair").agg(F.sum("n").alias("total"))
    out = found.join(sums, "pair").filter(F.col("n") * HOT >= F.col("total")).select("pair", "h").collect()
    keys = [np.array([r["h"] for r in out if r["pair"] == p], np.int64).view(np.uint64) for p in (False, True)]
    return keys[0], keys[1]


def _prefixes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, pa.Array]:
    """The phrases of at least k words, and their first k words."""
    space = np.flatnonzero(data == 0x20)
    before = np.searchsorted(space, offsets)
    size = np.diff(before) + 1
    at = np.flatnonzero(size >= k)
    # the k-th space of a phrase ends its prefix, or its end does
    stop = offsets[1:][at].copy()
    more = size[at] > k
    stop[more] = space[before[at[more]] + k - 1]
    length = stop - offsets[at]
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    letters = data[np.repeat(offsets[at] - (ends - length), length) + np.arange(total)]
    return at, pa.LargeStringArray.from_buffers(
        len(at), pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(letters))


def _sum(keys: pa.Array, n: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct keys, their sums, and each row's sum."""
    coded = keys.dictionary_encode()
    at = coded.indices.to_numpy()
    sums = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(sums, at, n)
    return coded.dictionary, sums, sums[at]


def _lines(column: pa.ChunkedArray) -> pa.Array:
    """The lines of all rows."""
    data, offsets = utf8(column.combine_chunks())
    letter = data != 0x0A
    # a line ends before its line feed, a row's last one at the row's end
    ends = np.sort(np.r_[np.flatnonzero(~letter), offsets[1:]])
    return pa.LargeStringArray.from_buffers(
        len(ends), pa.py_buffer(np.r_[0, np.cumsum(letter)[ends - 1]].astype(np.int64)), pa.py_buffer(data[letter]))


def _reduce(rows: pa.Table, longest: int, min_count: int) -> pa.Table:
    """One bucket: the sum of each window, padded behind its longest prefix of ``min_count`` occurrences."""
    lists = rows.column("n").combine_chunks()
    n = lists.flatten().to_numpy().astype(np.int64)
    split = np.repeat(rows.column("split").to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy())
    data, offsets = utf8(_lines(rows.column("phrases")))
    keep = np.ones(len(n), np.int64)
    for k in range(2, longest + 1):
        at, keys = _prefixes(data, offsets, k)
        total = _sum(keys, n[at])[2]
        stays = (total >= min_count) | (split[at] if k == 2 else False)
        keep[at[stays]] = k
    out_key, out_n = [], []
    for k in range(1, longest + 1):
        at, keys = _prefixes(data, offsets, k)
        own = keep[at] == k
        distinct, sums, _ = _sum(keys.filter(pa.array(own)), n[at][own])
        out_key.append(distinct)
        out_n.append(sums)
    keys = pa.chunked_array(out_key).combine_chunks().cast(pa.string())
    lang = pa.array([rows.column("lang")[0].as_py()] * len(keys), pa.string())
    return pa.table({"lang": lang, "phrase": keys, "n": pa.array(np.concatenate(out_n))})


def prefix_counts(docs: DataFrame, longest: int = 3, min_count: int = 10, lang_col: str = "lang",
                  text_col: str = "text") -> DataFrame:
    """lang, words (array), f: occurrences of every phrase of up to ``longest`` words with at least
    ``min_count`` of them, and of every single word; an empty array holds a language's number of words."""
    docs = narrow(docs, lang=lang_col, text=text_col)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    size = docs.agg(F.count(F.lit(1)).alias("rows"),
                    F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()
    hot_words, hot_pairs = hot_keys(docs, size["rows"])
    buckets = max(1, -(-size["bytes"] // BUCKET_BYTES))
    windows = docs.mapInArrow(lambda it: _count(it, longest, buckets, hot_words, hot_pairs),
                              "lang string, bucket long, split boolean, phrases string, n array<int>")
    reduced = windows.groupBy("lang", "bucket").applyInArrow(
        lambda rows: _reduce(rows, longest, min_count), "lang string, phrase string, n long")
    columns = [f"w{i}" for i in range(1, longest + 1)]
    words = F.split("phrase", " ", -1)
    leads = reduced.select("lang", *[F.get(words, F.lit(i)).alias(c) for i, c in enumerate(columns)], "n")
    sums = leads.rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # grouping_id has one bit for each column that is summed over, the last column lowest
    depth = F.lit(longest) - F.log2(F.col("level") + 1).cast("int")
    return (sums.filter(F.col("level") < 2 ** longest)
            .withColumn("depth", depth)
            .select("lang", F.slice(F.array(*columns), 1, F.col("depth")).alias("words"), "f", "depth")
            .filter((F.col("depth") == 0) | F.get("words", F.col("depth") - 1).isNotNull())
            .filter((F.col("depth") <= 1) | (F.col("f") >= min_count)).drop("depth"))


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in exact decimals; a phrase is no more frequent than its parts, so it is
    at most a million."""
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    return F.call_function("div", wide[0] * wide[0] * F.lit(1_000_000).cast("decimal(7,0)"), wide[1] * wide[2])


def collocations(docs: DataFrame, longest: int = 3, min_count: int = 10, cover_percent: int = 50,
                 top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words."""
    counts = materialise(prefix_counts(docs, longest, min_count, lang_col, text_col), "phrases")
    size = F.size("words")
    parts = counts.filter((size >= 1) & (F.col("f") >= min_count)).select(
        "lang", _phrase(F.col("words")).alias("part"), "f")
    found = counts.filter((size >= 2) & (F.col("f") >= min_count)).withColumnRenamed("f", "a")
    cuts = (found.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
            .withColumn("first", _phrase(F.slice("words", 1, F.col("k"))))
            .withColumn("rest", _phrase(F.slice("words", F.col("k") + 1, size - F.col("k")))))
    cuts = (cuts.join(parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    scored = (cuts.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
              .groupBy("lang", _phrase(F.col("words")).alias("phrase"))
              .agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best")))
    # phrases inside longer ones: of every longer phrase, its inner runs of two words or more
    longer = found.filter(size >= 3)
    inner = (longer.select("lang", "words", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
             .select("lang", "words", "a", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("at"))
             .groupBy("lang", _phrase(F.slice("words", F.col("at"), F.col("m"))).alias("phrase"))
             .agg(F.max("a").alias("longer")))
    kept = (scored.join(inner, ["lang", "phrase"], "left")
            .filter(F.coalesce(100 * F.col("longer") < cover_percent * F.col("a"), F.lit(True))))
    order = [F.col("best.score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of each salt first, so that no task sorts a whole language
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))) \
        .filter(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))) \
        .filter(F.col("rank") <= top)
    totals = counts.filter(size == 0).select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"),
        F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
