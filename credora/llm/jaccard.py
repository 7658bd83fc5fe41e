"""N-gram Jaccard join by a MinHash LSH forest and exact verification.

Every text is the set of its word n-grams. A signature of one-permutation minima (short texts are
hashed again into bins that stay empty) is a path of ``max_depth`` levels in each of ``trees``
prefix tries. The tries are kept sorted: Spark sorts all paths by range, so that a trie node is a run
of neighbouring rows, and the longest prefix that a row shares with its neighbour is its match.

Matches are used at the deepest level first. The share of links that this level finds is measured:
a pair of similarity s meets at depth d in some tree with probability 1 - (1 - s^d)^trees, and one
partner of every matched class, compared by signatures, tells which similarities occur. Until the
measured recall is ``target_recall``, all prefixes are shortened by a level. At ``forest_depth`` any pair at
the threshold is found with that probability, so no shorter prefix is needed; a few matches are no
evidence and lead there (see ``recall``). What matched deeper also matches at the final level.

Copies (equal word sequences) are one class from the start. Classes that meet in a trie node are
chained to the first one of its run, never paired; the chains' components are the units of
verification. A unit's n-gram sets travel once; inside a task an index over their rarest n-grams
finds the pairs that can reach the threshold, and each of these is counted exactly. Large
components are cut into blocks, and every pair of blocks is a unit of its own, so a task is bounded
and no pair is lost. Only counts and one chain for each unit leave a task, never all pairs.

Defined cases: a text of 1 to n - 1 words has one n-gram, its whole word sequence; a text without
words links to nothing and is its own class; ids are integers, rows with one id (or with a null
id) are one document; equal texts are linked; an empty table gives an empty result; other input
columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import materialise, narrow
from .graph import components
from .words import Words, mix, run_hash, slices, words_of

log = logging.getLogger(__name__)

NO_ID = 2 ** 63 - 1
LEVEL_BYTES = 2
EMPTY = np.uint64(2 ** 64 - 1)
ROUNDS = 16
BLOCK_CLASSES = 512
BLOCK_SHINGLES = 2_000_000
WORD_SEED, GRAM_SEED, TEXT_SEED, WORD_SEED2, TEXT_SEED2 = 11, 12, 13, 14, 15


def forest_depth(threshold: float, trees: int, max_depth: int, target_recall: float) -> int:
    """Prefix length at which a pair at the threshold is a candidate with the target probability."""
    for depth in range(max_depth, 0, -1):
        if meeting(threshold, depth, trees) >= target_recall:
            return depth
    raise ValueError("no prefix length reaches the target recall; use more trees")


def meeting(similarity: float, depth: int, trees: int) -> float:
    """Probability that two texts share a prefix of ``depth`` levels in some tree."""
    return 1 - (1 - similarity ** depth) ** trees


def recall(found: Iterable[tuple[float, int]], threshold: float, depth: int, trees: int,
           error: float) -> float:
    """Share of the links that meet at ``depth``, from (similarity, matches) of those that did: each
    stands for 1 / (its probability to meet). One link at the threshold is counted beside them, so
    that few matches prove little. Similarities are estimates with a standard ``error``: those up to
    two errors below the threshold count as links at the threshold."""
    met, all_ = meeting(threshold, depth, trees), 1.0
    for similarity, matches in found:
        if similarity >= threshold - 2 * error:
            met += matches
            all_ += matches / meeting(max(similarity, threshold), depth, trees)
    return met / all_


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams and their documents; a shorter text is one n-gram."""
    hashes = words.hashes(WORD_SEED)
    at = words.valid(n)
    grams, docs = words.windows(hashes, n, GRAM_SEED)[at], words.doc_of(at)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    whole = run_hash(hashes, words.first[short], words.first[short + 1], GRAM_SEED)
    return np.concatenate([grams, whole]), np.concatenate([docs, short])


def signatures(grams: np.ndarray, docs: np.ndarray, n_docs: int, bins: int) -> np.ndarray:
    """One-permutation minima of each document. Texts with empty bins are hashed again, round by
    round, into the bins still empty; what ``ROUNDS`` leave empty takes the next bin's, rotated."""
    sig = np.full(n_docs * bins, EMPTY)
    for turn in range(ROUNDS):
        h = mix(grams ^ np.uint64(turn * 0x9E3779B97F4A7C15 % 2 ** 64))
        place = docs * bins + (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
        open_ = sig[place] == EMPTY
        np.minimum.at(sig, place[open_], mix(h[open_]))
        again = (sig.reshape(n_docs, bins) == EMPTY).any(axis=1)[docs]
        grams, docs = grams[again], docs[again]
        if not len(grams):
            break
    sig = sig.reshape(n_docs, bins)
    twice = np.concatenate([sig, sig], axis=1)
    far = 4 * bins
    source = np.where(twice != EMPTY, np.arange(2 * bins), far)
    source = np.minimum.accumulate(source[:, ::-1], axis=1)[:, ::-1][:, :bins]
    steps = source - np.arange(bins)
    filled = np.take_along_axis(sig, source % bins, axis=1)
    return np.where(steps == 0, filled, mix(filled + steps.astype(np.uint64)))


def tree_paths(sig: np.ndarray, trees: int) -> np.ndarray:
    """A signature as its paths, one tree after the other: each level is ``LEVEL_BYTES`` bytes of a
    hash of the minimum and the tree, so that paths of different trees do not meet."""
    tree = mix(np.arange(trees, dtype=np.uint64))
    levels = mix(sig.reshape(len(sig), trees, -1) ^ tree[None, :, None])
    return (levels >> np.uint64(64 - 8 * LEVEL_BYTES)).astype(f">u{LEVEL_BYTES}").reshape(len(sig), -1)


def _text_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    begin, end = words.first[:-1], words.first[1:]
    return (run_hash(words.hashes(WORD_SEED), begin, end, TEXT_SEED).view(np.int64),
            run_hash(words.hashes(WORD_SEED2), begin, end, TEXT_SEED2).view(np.int64))


def _sign(batches: Iterator[pa.RecordBatch], n: int, trees: int, max_depth: int
          ) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = words_of(part, "text")
            grams, docs = shingles(words, n)
            sizes = np.bincount(docs, minlength=part.num_rows)
            sig = signatures(grams, docs, part.num_rows, trees * max_depth)
            paths = [x.tobytes() for x in tree_paths(sig, trees)]
            c1, c2 = _text_keys(words)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("text_key"), pa.array(c1), pa.array(c2),
                 pa.array(sizes, pa.int64()), pa.array(paths, pa.binary())],
                names=["id", "text_key", "c1", "c2", "size", "paths"])


def _levels(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of levels."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), f">u{LEVEL_BYTES}").reshape(len(values), -1)


MATCHES = "a long, b long, depth int, part int, last boolean, path binary"


def _matches(batches: Iterator[pa.RecordBatch], floor: int, max_depth: int) -> Iterator[pa.RecordBatch]:
    """From sorted (path, rep) rows: each row a whose shared prefix with the row before has ``floor``
    levels or more, with the first row b of its run at that depth. The first and last row of the
    partition follow with their paths, for the seams between partitions."""
    part = TaskContext.get().partitionId()
    deep = np.arange(floor, max_depth + 1)
    before, heads = None, None  # last row's levels, first rep of its run at each depth

    def rows(a, b, depth, last=None, path=None):
        own = part if last is not None else None
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(depth, pa.int32()),
             *[pa.repeat(pa.scalar(x, t), len(a)) for x, t in
               ((own, pa.int32()), (last, pa.bool_()), (path, pa.binary()))]],
            names=["a", "b", "depth", "part", "last", "path"])

    for batch in batches:
        if not batch.num_rows:
            continue
        levels, reps = _levels(batch.column("path")), batch.column("rep").to_numpy()
        if before is None:
            yield rows(reps[:1], [None], [None], False, levels[0].tobytes())
            before, heads = ~levels[0], np.zeros(len(deep), np.int64)
        same = levels == np.concatenate([before[None], levels[:-1]])
        shared = np.cumprod(same, axis=1, dtype=np.int64).sum(axis=1)
        starts = np.where(shared[:, None] < deep, np.arange(len(reps))[:, None], -1)
        starts = np.maximum.accumulate(starts, axis=0)
        firsts = np.where(starts >= 0, reps[starts], heads)
        at = np.flatnonzero(shared >= floor)
        yield rows(reps[at], firsts[at, shared[at] - floor], shared[at])
        before, heads, rep = levels[-1], firsts[-1], reps[-1]
    if before is not None:
        yield rows([rep], [None], [None], True, before.tobytes())


def _forest(classes: DataFrame, trees: int, floor: int, max_depth: int) -> DataFrame:
    """(a, b, depth): chains of the classes that share a prefix of ``floor`` levels or more. All rows of
    a trie node are connected by chains of its depth or deeper."""
    width = LEVEL_BYTES * max_depth
    paths = classes.select(F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.substring(F.col("paths"), t * width + 1, F.lit(width)))).alias("path"), "rep")
    # ordered by rep inside a node as well: a node of very many classes is cut into several ranges
    ordered = paths.repartitionByRange("path", "rep").sortWithinPartitions("path", "rep")
    found = materialise(ordered.mapInArrow(lambda it: _matches(it, floor, max_depth), MATCHES), "forest")
    # two rows for each partition
    order = Window.orderBy("part", "last")
    prefix = lambda column, d: F.substring(column, 1, LEVEL_BYTES * d)
    seams = (found.filter("part is not null")
             .select("a", "path", "last", F.lag("a").over(order).alias("b"),
                     F.lag("path").over(order).alias("other"))
             .filter("not last and b is not null")
             .select("a", "b", F.coalesce(*[F.when(prefix("path", d) == prefix("other", d), d)
                                            for d in range(max_depth, floor - 1, -1)]).alias("depth"))
             .filter("depth is not null"))
    return found.filter("part is null").select("a", "b", "depth").unionAll(seams).filter("a != b")


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            equal = (_levels(batch.column("paths")) == _levels(batch.column("other"))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("depths"), pa.array(equal, pa.int32())],
                                             names=["depths", "equal"])


def measured_depth(chains: DataFrame, classes: DataFrame, threshold: float, trees: int,
                   max_depth: int, floor: int, target_recall: float) -> tuple[int, float]:
    """The deepest level whose measured recall reaches the target, and that recall. Every matched
    class is compared with one partner at each depth; the driver gets counts of equal minima."""
    deep = list(range(floor, max_depth + 1))
    first = chains.groupBy("a").agg(*[
        F.min(F.when(F.col("depth") >= d, F.col("b"))).alias(f"b{d}") for d in deep])
    partners = F.array_distinct(F.array_compact(F.array(*[f"b{d}" for d in deep])))
    pairs = first.select("*", F.explode(partners).alias("b")).select(
        "a", "b", F.array_compact(F.array(*[
            F.when(F.col(f"b{d}") == F.col("b"), F.lit(d)) for d in deep])).alias("depths"))
    mine = classes.select(F.col("rep").alias("a"), "paths")
    others = classes.select(F.col("rep").alias("b"), F.col("paths").alias("other"))
    counts = (pairs.join(mine, "a").join(others, "b").select("depths", "paths", "other")
              .mapInArrow(_agreement, "depths array<int>, equal int")
              .select(F.explode("depths").alias("depth"), "equal")
              .groupBy("depth", "equal").count().collect())  # at most depths x (minima + 1) rows
    minima = trees * max_depth
    error = (threshold * (1 - threshold) / minima) ** 0.5
    for depth in reversed(deep):
        share = recall([(r["equal"] / minima, r["count"]) for r in counts if r["depth"] == depth],
                       threshold, depth, trees, error)
        log.info("prefixes of %d levels: measured recall %.6f", depth, share)
        if share >= target_recall or depth == floor:
            return depth, share


SETS = "comp long, i int, j int, rep long, block int, copies long, grams binary"


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A representative's distinct n-grams, once for each pair of blocks that its block is in."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = words_of(part, "text")
            grams, docs = shingles(words, n)
            own = _text_keys(words)[0] == part.column("c1").to_numpy()
            order = np.lexsort((grams, docs))
            grams, docs = grams[order], docs[order]
            bounds = np.searchsorted(docs, np.arange(part.num_rows + 1))
            out: dict[str, list] = {k: [] for k in ("at", "i", "j", "grams")}
            blocks = part.column("block").to_pylist()
            for row, count in enumerate(part.column("blocks").to_pylist()):
                if own[row]:
                    held = np.unique(grams[bounds[row]:bounds[row + 1]]).tobytes()
                    for other in range(count):
                        out["at"].append(row)
                        out["i"].append(min(blocks[row], other))
                        out["j"].append(max(blocks[row], other))
                        out["grams"].append(held)
            at = pa.array(out["at"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("comp").take(at), pa.array(out["i"], pa.int32()),
                 pa.array(out["j"], pa.int32()), part.column("rep").take(at),
                 part.column("block").take(at), part.column("copies").take(at),
                 pa.array(out["grams"], pa.binary())],
                names=["comp", "i", "j", "rep", "block", "copies", "grams"])


def linked(sets: list[np.ndarray], side: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Matrix of the pairs of sets with Jaccard >= threshold; if two sides are given, of pairs
    across them only. Sets are sorted and distinct."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # rarest first; a pair at the threshold shares one of its rarest n-grams
    rank = np.empty(len(values), dtype=np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(values))
    order = np.lexsort((rank[token], owner))
    owner, token = owner[order], token[order]
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    needed = -(-sizes * threshold.numerator // threshold.denominator)
    prefix = (place <= (sizes - needed)[owner]) & (count[token] > 1)
    across = np.ones((n, n), dtype=bool) if side.min() == side.max() else \
        side[:, None] != side[None, :]
    candidate = np.zeros((n, n), dtype=bool)
    held, by = token[prefix], owner[prefix]
    order = np.argsort(held, kind="stable")
    held, by = held[order], by[order]
    for group in np.split(by, np.flatnonzero(np.diff(held)) + 1):
        if len(group) > 1:
            candidate[group[:, None], group[None, :]] = True
    candidate &= across
    np.fill_diagonal(candidate, False)
    shared = count[token] > 1
    token, owner = token[shared], owner[shared]
    by_token = np.argsort(token, kind="stable")
    holders = owner[by_token]
    first = np.searchsorted(token[by_token], np.arange(len(values) + 1))
    bounds = np.searchsorted(owner, np.arange(n + 1))
    found = np.zeros((n, n), dtype=bool)
    for a in np.flatnonzero(candidate.any(axis=1)):
        mine = token[bounds[a]:bounds[a + 1]]
        lengths = first[mine + 1] - first[mine]
        ends = np.cumsum(lengths)
        at = np.repeat(first[mine] - (ends - lengths), lengths) + np.arange(ends[-1])
        common = np.bincount(holders[at], minlength=n)
        union = sizes[a] + sizes - common
        found[a] = candidate[a] & (common * threshold.denominator >= union * threshold.numerator)
    return found


def _roots(found: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """The smallest representative that each one is connected to."""
    root = reps.copy()
    open_ = found.any(axis=1)
    while open_.any():
        reached = np.zeros(len(reps), dtype=bool)
        reached[np.flatnonzero(open_)[0]] = True
        size = 0
        while size != (size := int(reached.sum())):
            reached |= found[reached].any(axis=0)
        root[reached] = reps[reached].min()
        open_ &= ~reached
    return root


def _verify(unit: pa.Table, threshold: str) -> pa.Table:
    """rep, links (documents linked to it inside the unit) and root."""
    unit = unit.sort_by([("rep", "ascending"), ("block", "ascending")])
    reps = unit.column("rep").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in unit.column("grams").to_pylist()]
    # rows repeated exactly count once
    keep = [k for k in range(len(sets)) if k == 0 or reps[k] != reps[k - 1]
            or not np.array_equal(sets[k], sets[k - 1])]
    reps, sets = reps[keep], [sets[k] for k in keep]
    side, copies = unit.column("block").to_numpy()[keep], unit.column("copies").to_numpy()[keep]
    i, j = unit.column("i")[0].as_py(), unit.column("j")[0].as_py()
    if len(sets) < 2 or (i != j and side.min() == side.max()):
        found = np.zeros((len(sets), len(sets)), dtype=bool)
    else:
        found = linked(sets, side, Fraction(threshold))
        found &= reps[:, None] != reps[None, :]
    return pa.table({"rep": reps, "links": found @ copies, "root": _roots(found, reps)})


def near_duplicates(docs: DataFrame, threshold: str = "0.8", n: int = 5, trees: int = 32,
                    max_depth: int = 8, target_recall: float = 0.9999,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), copy_id (smallest id with the same words), class_id (smallest id among all documents
    connected by links) and n_links (other documents at the threshold, copies included) for every
    input row."""
    floor = forest_depth(float(Fraction(threshold)), trees, max_depth, target_recall)
    docs = narrow(docs, doc_id=id_col, text=text_col)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    signed = materialise(keyed.select("id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        lambda it: _sign(it, n, trees, max_depth),
        "id long, text_key long, c1 long, c2 long, size long, paths binary"), "signed")
    classes = materialise(
        signed.filter("size > 0").groupBy("c1", "c2").agg(
            F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"),
            F.max("size").alias("size"), F.first("paths").alias("paths")), "classes")
    chains = materialise(_forest(classes, trees, floor, max_depth), "chains")
    depth, _ = measured_depth(chains, classes, float(Fraction(threshold)), trees, max_depth, floor,
                              target_recall)
    units = _units(classes, chains.filter(F.col("depth") >= depth).select("a", "b"))
    # texts travel once; only candidates' n-grams travel on
    sets = (keyed.join(units, F.col("id") == F.col("rep"))
            .select("comp", "rep", "c1", "block", "blocks", "copies", "text")
            .mapInArrow(lambda it: _sets(it, n), SETS))
    found = materialise(
        sets.groupBy("comp", "i", "j").applyInArrow(
            lambda unit: _verify(unit, threshold), "rep long, links long, root long")
        .filter("links > 0").groupBy("rep", "root").agg(F.sum("links").alias("links")), "links")
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classed = (classes.select("c1", "c2", "rep", "copies")
               .join(links, "rep", "left")
               .join(roots, F.col("rep") == F.col("node"), "left")
               .select("c1", "c2", F.col("rep").alias("copy_id"),
                       F.coalesce("root", "rep").alias("class_id"),
                       (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    own = signed.select("id", "text_key", F.when(F.col("size") > 0, F.col("c1")).alias("c1"), "c2")
    return (own.join(classed, ["c1", "c2"], "left")
            .select(*[F.nullif(F.coalesce(x, "id"), F.lit(NO_ID)).alias(name) for x, name in
                      ((F.col("id"), "doc_id"), (F.col("copy_id"), "copy_id"),
                       (F.col("class_id"), "class_id"))],
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "text_key"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **join) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose document has the smallest id of its
    class."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **join)
    gone = materialise(found.filter(~F.col("doc_id").eqNullSafe(F.col("class_id")))
                       .select(F.coalesce("doc_id", F.lit(NO_ID)).alias("gone_id"),
                               F.col("text_key").alias("gone_key")).distinct(), "copies")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"),
                        F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"))
    return keyed.join(gone, (F.col("id") == F.col("gone_id"))
                      & (F.col("text_key") == F.col("gone_key")), "left_anti").select("doc.*")


def _units(classes: DataFrame, chains: DataFrame) -> DataFrame:
    """rep, c1, copies, comp, block, blocks of every class that meets another in a trie node."""
    roots = components(chains)
    held = classes.select("rep", "c1", "copies", "size").join(roots, F.col("rep") == F.col("node"))
    counts = held.groupBy("root").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES),
        F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    counts = materialise(counts.withColumnRenamed("root", "comp"), "units")
    return held.join(counts, F.col("root") == F.col("comp")).select(
        "rep", "c1", "copies", "comp",
        F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "blocks")
