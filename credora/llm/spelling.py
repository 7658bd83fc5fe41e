"""Spelling variants: words one edit apart, found by a search of a trie of letter-group counts.

A word becomes its frequency vector: how often letters of each of ``GROUPS`` letter groups occur in it
(the groups are balanced over the vocabulary). The trie has one level for each group and a child for
each count. An inserted letter raises one count, a deleted one lowers one, a replaced one does both or
neither, so the depth-first search from a word has a surplus of one and a deficit of one to spend on
its way down; the words of each leaf it reaches are verified letter by letter. Of two near words the
search finds the pair from the side whose first differing count is the smaller one (the surplus is
spent first), or, with equal vectors, from the smaller word; both words are credited.

On Spark the vocabulary is counted from all documents, and the trie is cut into subtrees: nodes with
more than ``limit`` words are inner nodes (at most the vocabulary over ``limit`` on each level, the only
thing the driver holds), every other child of an inner node is a subtree and the key of one group.
A word goes to its own subtree as a member, and as a query to those its budget lets it reach. A task
searches its subtree for blocks of queries, level by level within a block and depth first over
blocks, so that memory follows the block. Leaves of many words (anagrams) are searched through an
index of word halves, one of which any single edit leaves alone, instead of pair by pair. A task
returns one row for each of its words: near words seen and the best of them.

Defined cases: a null text has no words, a null id reads ``null``; repeated rows count each; words are
maximal runs of A-Z, a-z and U+00C0..U+00FF, of which only A-Z are lower-cased; an empty table gives
an empty result; other input columns are ignored. Texts and words may have any length.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import materialise, narrow

GROUPS = 16
INNER_NODES = 4096     # the most inner nodes on a level of the trie
SUBTREE_WORDS = 8192   # words of a subtree, unless the vocabulary asks for more
BLOCK = 8192           # queries searched together
STATES = 1 << 18       # search states expanded at once
PAIRS = 1 << 20        # pairs verified at once
BIG_LEAF = 256
WIDE = 64              # longer words are verified one pair at a time
FLUSH = 400_000        # distinct words a counting task holds

# Latin-1 bytes: letters lower-cased (A-Z only), everything else a space.
LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0xC0 else c + 32 if 0x41 <= c <= 0x5A else 0x20
                for c in range(256))


def runs_of(text: str) -> list[bytes]:
    """Letter runs of a text as Latin-1 bytes; other characters separate."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def _rows(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())],
        names=["w", "n"])


def _count(batches: Iterator[pa.RecordBatch], modulus: int, min_chars: int
           ) -> Iterator[pa.RecordBatch]:
    """(w, n) of the words of each document; where the checksum says so, one letter is missing."""
    counts: Counter = Counter()
    for batch in batches:
        for key, text in zip(batch.column("id").to_pylist(), batch.column("text")):
            start = zlib.crc32(f"{key}:".encode())
            for run, n in Counter(runs_of(text.as_py() or "")).items():
                if len(run) < min_chars:
                    continue
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                if h % modulus == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
                    if len(run) < min_chars:
                        continue
                counts[run] += n
            if len(counts) > FLUSH:
                yield _rows(counts)
                counts = Counter()
    yield _rows(counts)


def vocabulary(docs: DataFrame, modulus: int = 97, min_chars: int = 5, min_count: int = 3,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(w Latin-1 binary, n) of the words with at least ``min_count`` occurrences."""
    docs = narrow(docs, id=id_col, text=text_col)
    docs = docs.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("id"), "text")
    words = docs.mapInArrow(lambda it: _count(it, modulus, min_chars), "w binary, n long")
    return words.groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ---- the trie ---------------------------------------------------------------------------------

def letter_groups(frequency: np.ndarray) -> np.ndarray:
    """Letters (byte values) dealt to ``GROUPS`` groups of about equal frequency, frequent ones first."""
    load, group = [0] * GROUPS, np.zeros(256, np.int64)
    for c in np.argsort(-frequency, kind="stable"):
        group[c] = g = int(np.argmin(load))
        load[g] += int(frequency[c])
    return group


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column."""
    column = pc.cast(column, pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def vectors(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """One row of letter-group counts for each word."""
    n = len(offsets) - 1
    word = np.repeat(np.arange(n), np.diff(offsets))
    return np.bincount(word * GROUPS + groups[data], minlength=n * GROUPS).reshape(n, GROUPS)


class Level:
    """The children of one level: (node, count) -> child, or -1."""

    DENSE = 1 << 24

    def __init__(self, node: np.ndarray, count: np.ndarray):
        """node, count: one pair for each child, sorted; children are numbered in that order."""
        self.width = int(count.max(initial=0)) + 2
        self.keys = node * self.width + count
        self.table = None
        size = (int(node[-1]) + 1) * self.width if len(node) else 0
        if size <= self.DENSE:
            self.table = np.full(max(size, 1), -1, np.int64)
            self.table[self.keys] = np.arange(len(node))

    def child(self, node: np.ndarray, count: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(node), -1)
        known = count < self.width
        key = np.where(known, node * self.width + count, 0)
        if self.table is not None:
            inside = key < len(self.table)
            found = self.table[np.where(inside, key, 0)]
            return np.where(known & inside, found, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(known & (self.keys[at] == key), at, -1)


def branches(count: np.ndarray, spent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The ways down from states with these counts: (states, child count, budget spent on the way).
    spent: 0 nothing, 1 the surplus, 2 the surplus and then the deficit."""
    yield np.arange(len(count)), count, 0
    up = np.flatnonzero(spent == 0)
    yield up, count[up] + 1, 1
    down = np.flatnonzero((spent == 1) & (count > 0))
    yield down, count[down] - 1, 1


class Trie:
    """Words in the order of their vectors, one ``Level`` for each letter group."""

    def __init__(self, vec: np.ndarray):
        self.order = np.lexsort(vec.T[::-1])
        node = np.zeros(len(vec), np.int64)
        self.levels = []
        for t in range(GROUPS):
            count = vec[self.order, t]
            new = np.ones(len(vec), bool)
            new[1:] = (node[1:] != node[:-1]) | (count[1:] != count[:-1])
            self.levels.append(Level(node[new], count[new]))
            node = np.cumsum(new) - 1
        self.first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(vec) else node
        self.size = np.diff(np.r_[self.first, len(vec)])

    def search(self, vec: np.ndarray, queries: np.ndarray
               ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, leaf, budget spent) of all leaves within the budget, depth first over blocks."""
        stack = [(0, q, np.zeros(len(q), np.int64), np.zeros(len(q), np.int8))
                 for q in _blocks(queries, BLOCK)]
        while stack:
            t, q, node, spent = stack.pop()
            if t == GROUPS:
                yield q, node, spent
                continue
            parts = []
            for at, count, step in branches(vec[q, t], spent):
                child = self.levels[t].child(node[at], count)
                here = child >= 0
                at = at[here]
                parts.append((q[at], child[here], spent[at] + np.int8(step)))
            q, node, spent = (np.concatenate(x) for x in zip(*parts))
            stack += [(t + 1, q[b], node[b], spent[b]) for b in _blocks(np.arange(len(q)), STATES)]


def _blocks(items: np.ndarray, size: int) -> list[np.ndarray]:
    return [items[i:i + size] for i in range(0, len(items), size)]


# ---- one subtree ------------------------------------------------------------------------------

class Verifier:
    """Decides which pairs of words are exactly one edit apart."""

    def __init__(self, words: list[bytes], data: np.ndarray, offsets: np.ndarray):
        self.words, self.length = words, np.diff(offsets)
        width = min(WIDE, int(self.length.max(initial=1)))
        short = self.length <= width
        at = np.arange(len(data)) - np.repeat(offsets[:-1], self.length)
        row = np.repeat(np.arange(len(words)), self.length)
        back = np.repeat(self.length, self.length) - 1 - at
        use = np.repeat(short, self.length)
        self.left = np.zeros((len(words), width), np.uint8)
        self.right = np.zeros((len(words), width), np.uint8)
        self.left[row[use], at[use]] = data[use]
        self.right[row[use], back[use]] = data[use]
        self.short = short

    def __call__(self, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Marks of the near pairs. same: pairs of equal vectors, which count only where word a is the
        smaller one."""
        la, lb = self.length[a], self.length[b]
        ok = np.abs(la - lb) <= 1
        small = ok & self.short[a] & self.short[b]
        at = np.flatnonzero(small)
        x, y = a[at], b[at]
        front = self.left[x] != self.left[y]
        head = front.argmax(1)
        differ = front[np.arange(len(at)), head]
        tail = (self.right[x] != self.right[y]).argmax(1)
        near = differ & (head + tail >= np.maximum(la[at], lb[at]) - 1)
        near &= ~same[at] | (self.left[x, head] < self.left[y, head])
        out = np.zeros(len(a), bool)
        out[at] = near
        for i in np.flatnonzero(ok & ~small):
            u, v = self.words[a[i]], self.words[b[i]]
            out[i] = one_edit(u, v) and (not same[i] or u < v)
        return out


def one_edit(u: bytes, v: bytes) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    x, y = np.frombuffer(u, np.uint8), np.frombuffer(v, np.uint8)
    n = min(len(x), len(y))
    head = x[:n] != y[:n]
    tail = x[::-1][:n] != y[::-1][:n]
    return ((int(head.argmax()) if head.any() else n) + (int(tail.argmax()) if tail.any() else n)
            >= max(len(x), len(y)) - 1)


class Halves:
    """Members of a big leaf by the halves that one edit leaves alone."""

    def __init__(self, words: list[bytes], members: np.ndarray):
        self.by: dict = defaultdict(list)
        for m in members.tolist():
            w = words[m]
            for n in (len(w) - 1, len(w), len(w) + 1):
                self.by[n, w[:n // 2]].append(m)
                self.by[-n, w[len(w) - (n - n // 2):]].append(m)

    def partners(self, word: bytes) -> list[int]:
        n = len(word)
        return list({*self.by.get((n, word[:n // 2]), ()), *self.by.get((-n, word[n // 2:]), ())})


def _pairs(trie: Trie, members: np.ndarray, words: list[bytes], vec: np.ndarray, queries: np.ndarray
           ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, member, equal vectors) for all leaves the search reaches, in bounded parts."""
    halves: dict[int, Halves] = {}
    for q, leaf, spent in trie.search(vec, queries):
        size = trie.size[leaf]
        big = size > BIG_LEAF
        for i in np.flatnonzero(big).tolist():
            at = int(leaf[i])
            if at not in halves:
                begin = trie.first[at]
                halves[at] = Halves(words, members[trie.order[begin:begin + trie.size[at]]])
            found = np.array(halves[at].partners(words[q[i]]), np.int64)
            yield np.full(len(found), q[i]), found, np.full(len(found), spent[i] == 0)
        q, leaf, spent, size = q[~big], leaf[~big], spent[~big], size[~big]
        ends = np.cumsum(size)
        cuts = np.searchsorted(ends, np.arange(PAIRS, ends[-1] + PAIRS, PAIRS), "right") if len(ends) else []
        begin = 0
        for cut in cuts:
            part = slice(begin, max(cut, begin + 1))
            begin = part.stop
            n = size[part]
            if not n.sum():
                continue
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(trie.first[leaf[part]], n) + inner
            yield np.repeat(q[part], n), members[trie.order[at]], np.repeat(spent[part] == 0, n)


def _search(rows: pa.Table, groups: np.ndarray) -> pa.Table:
    """One subtree: near words seen and the best of them for each row."""
    column = pc.cast(rows.column("w").combine_chunks(), pa.large_binary())
    data, offsets = _letters(column)
    words, n = column.to_pylist(), rows.column("n").to_numpy()
    member = rows.column("member").to_numpy(zero_copy_only=False)
    members, queries = np.flatnonzero(member), np.flatnonzero(~member)
    vec = vectors(data, offsets, groups)
    # the best near word: most occurrences, then the smallest
    place = np.empty(len(words), np.int64)
    sequence = np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])), np.int64)
    place[sequence] = np.arange(len(words))
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    if len(members) and len(queries):
        verify = Verifier(words, data, offsets)
        for a, b, same in _pairs(Trie(vec[members]), members, words, vec, queries):
            ok = verify(a, b, same)
            a, b = a[ok], b[ok]
            for x, y in ((a, b), (b, a)):
                near += np.bincount(x, minlength=len(words))
                np.minimum.at(best, x, place[y])
    some = best < len(words)
    first = pa.array(sequence[np.where(some, best, 0)], mask=~some)
    return pa.table({"w": column.cast(pa.binary()), "n": pa.array(n), "near": pa.array(near),
                     "form_n": rows.column("n").take(first), "form": rows.column("w").take(first)})


def _route(batches: Iterator[pa.RecordBatch], groups: np.ndarray, levels: list[Level]
           ) -> Iterator[pa.RecordBatch]:
    """(node, count, member, w, n): each word's own subtree and those a search from it may reach.
    A subtree is an inner node (numbered over all levels) and a count that is no inner node below."""
    base = np.cumsum([0, *[1 if t == 0 else len(levels[t - 1].keys) for t in range(len(levels))]])
    for batch in batches:
        vec = vectors(*_letters(batch.column("w")), groups)
        for block in _blocks(np.arange(batch.num_rows), BLOCK):
            q, node, spent = block, np.zeros(len(block), np.int64), np.zeros(len(block), np.int8)
            out = []
            for t, level in enumerate(levels):
                parts = []
                for at, count, step in branches(vec[q, t], spent):
                    child = level.child(node[at], count)
                    now = spent[at] + np.int8(step)
                    stop = child < 0
                    out.append((q[at[stop]], base[t] + node[at[stop]], count[stop], now[stop]))
                    parts.append((q[at[~stop]], child[~stop], now[~stop]))
                q, node, spent = (np.concatenate(x) for x in zip(*parts))
            # inner nodes below the last level are leaves of many words
            out.append((q, base[len(levels)] + node, np.zeros(len(q), np.int64), spent))
            q, node, count, spent = (np.concatenate(x) for x in zip(*out))
            own = np.flatnonzero(spent == 0)
            take = np.r_[own, np.arange(len(q))]
            rows = pa.array(q[take])
            member = np.arange(len(take)) < len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[take]), pa.array(count[take]), pa.array(member),
                 batch.column("w").take(rows), batch.column("n").take(rows)],
                names=["node", "count", "member", "w", "n"])


def _inner_levels(words: DataFrame, groups: np.ndarray, limit: int) -> list[Level]:
    """The levels of the trie's top: children with more than ``limit`` words. Each level has at most
    the vocabulary over ``limit`` of them."""
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = vectors(*_letters(batch.column("w")), groups)
            flat = pa.array(vec.ravel(), pa.int64())
            at = pa.array(np.arange(0, len(flat) + 1, GROUPS), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, flat)], names=["vec"])

    counts = words.select("w").mapInArrow(prefixes, "vec array<long>")
    levels, parents = [], {(): 0}
    for t in range(GROUPS):
        found = (counts.groupBy(F.slice("vec", 1, t + 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
                 .filter(F.col("n") > limit).select("prefix").collect())
        nodes = sorted((parents[tuple(r["prefix"][:-1])], *r["prefix"]) for r in found)
        levels.append(Level(np.array([x[0] for x in nodes], np.int64),
                            np.array([x[-1] for x in nodes], np.int64)))
        parents = {x[1:]: i for i, x in enumerate(nodes)}
        if not nodes:
            break
    return levels


def _frequencies(words: DataFrame) -> np.ndarray:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            total += np.bincount(_letters(batch.column("w"))[0], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["c", "n"])

    out = np.zeros(256, np.int64)
    for r in words.mapInArrow(sums, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
        out[r["c"]] = r["n"]
    return out


def near_words(words: DataFrame) -> DataFrame:
    """(w, n, near, form_n, form) for each row of a written vocabulary (w, n): the number of words one
    edit away and the most frequent of them (ties: the smallest), null where there is none."""
    groups = letter_groups(_frequencies(words))
    limit = max(SUBTREE_WORDS, -(-words.count() // INNER_NODES))
    levels = _inner_levels(words, groups, limit)
    routed = words.mapInArrow(lambda it: _route(it, groups, levels),
                              "node long, count long, member boolean, w binary, n long")
    found = routed.groupBy("node", "count").applyInArrow(
        lambda rows: _search(rows.select(["member", "w", "n"]), groups),
        "w binary, n long, near long, form_n long, form binary")
    best = F.struct((-F.col("form_n")).alias("by"), "form")
    return (found.groupBy("w").agg(F.max("n").alias("n"), F.sum("near").alias("near"),
                                   F.min(F.when(F.col("form").isNotNull(), best)).alias("best"))
            .select("w", "n", "near", (-F.col("best.by")).alias("form_n"), F.col("best.form").alias("form")))


def _ends(links: DataFrame) -> DataFrame:
    """(w, at): the end of each word's chain of forms, by doubling. Along a chain the counts grow by the
    ratio, so chains are short and end; words at their end leave the rounds."""
    chains = links.withColumn("done", F.lit(False))
    while not chains.filter("NOT done").isEmpty():
        ahead = chains.select(F.col("w").alias("at"), F.col("at").alias("next"), F.col("done").alias("ended"))
        moved = chains.filter("NOT done").drop("done").join(ahead, "at", "left").select(
            "w", F.coalesce("next", "at").alias("at"), F.coalesce("ended", F.lit(True)).alias("done"))
        chains = materialise(moved.unionByName(chains.filter("done")), "spelling-chains")
    return chains.select("w", "at")


def group_variants(docs: DataFrame, modulus: int = 97, min_chars: int = 5, min_count: int = 3,
                   ratio: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the documents."""
    words = materialise(vocabulary(docs, modulus, min_chars, min_count, id_col, text_col), "spelling-words")
    near = materialise(
        near_words(words).withColumn("is_form", F.col("form_n") >= ratio * F.col("n"))
        .select("w", "n", "near", F.when(F.col("is_form"), F.col("form")).alias("form"),
                F.when(F.col("is_form"), F.col("form_n")).alias("form_n")), "spelling-near")
    roots = _ends(near.filter("form IS NOT NULL").select("w", F.col("form").alias("at")))
    text = lambda c: F.decode(c, "ISO-8859-1")
    return (near.join(roots, "w", "left")
            .select(text(F.col("w")).alias("word"), text(F.col("form")).alias("form"),
                    text(F.coalesce("at", "w")).alias("root"), "n", F.col("near").alias("n_near"), "form_n"))
