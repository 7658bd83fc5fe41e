"""Boosted trees grown as Spark's ``GBTClassifier`` grows them, from binned rows in NumPy.

Split candidates are Spark's own (``RandomForest.findSplits`` on the same rows and seed), and so are the gain, the order in
which ties are met, the bounds on a node and the step from tree to tree; the fitted model is Spark's class, read from
its saved form. What differs is how sums by node, feature and bin are made: ``bincount`` over blocks of binned rows, one Spark
job of one stage for a level. Up to ``LOCAL_ROWS`` one task grows all trees, since a job for each level would
cost more than its rows. Two savings leave the sums the same but for rounding: features share a code where their
bins multiply to 256 at most, and of two sibling nodes only the one with fewer rows is summed, the other is what is
left of their parent. Equal gains may so fall to another of the tied splits, as they may in Spark where its parts meet in
another order: rows of the fit are parted alike, a new row may score otherwise.

Tables up to ``SMALL_ROWS``, and fits that sample rows or features, stop early, have categorical features or few
trees are left to Spark.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credora.session import ensure_checkpoint_dir, scratch_path

FEW_TREES = 20         # below, binning and reading the model back cost more than they save
SMALL_ROWS = 150_000   # up to here Spark's own fit is quick enough
LOCAL_ROWS = 1_000_000  # up to here one task grows all trees
BLOCK_ROWS = 131_072   # rows binned together
CODES = 256            # bins of the features that share a code, multiplied
EPSILON = 2.0 ** -52   # Spark's: a node of less impurity is not split
MERGED = 64            # parts whose sums the driver adds up by itself
TREE_PARAMS = {"cacheNodeIds", "checkpointInterval", "featuresCol", "labelCol", "maxDepth", "seed", "maxBins", "maxMemoryInMB",
               "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "leafCol", "predictionCol", "impurity",
               "weightCol"}
NODES = ("treeID int, nodeData struct<id:int, prediction:double, impurity:double, impurityStats:array<double>, rawCount:bigint, "
         "gain:double, leftChild:int, rightChild:int, "
         "split:struct<featureIndex:int, leftCategoriesOrThreshold:array<double>, numCategories:int>>")


def can_grow(est, df: DataFrame) -> bool:
    """Whether the fit of ``est`` on ``df`` is one this module does in full."""
    if not isinstance(est, GBTClassifier) or est.getSubsamplingRate() != 1.0 or est.getMaxBins() > CODES:
        return False
    if est.getMaxIter() < FEW_TREES:
        return False
    attrs = df.schema[est.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
    return (est.getFeatureSubsetStrategy() in ("all", "auto") and not est.isDefined("validationIndicatorCol")
            and not attrs.get("nominal") and not attrs.get("binary"))


@dataclass(frozen=True)
class Rules:
    """What a tree must keep to."""
    depth: int
    min_rows: int
    min_weight: float
    min_gain: float
    n_splits: tuple[int, ...]


@dataclass(frozen=True)
class Codes:
    """Features that share a code: each one's group, and the product of the bins of those before it in the group."""
    group: tuple[int, ...]
    unit: tuple[int, ...]
    bins: tuple[int, ...]
    width: int

    @classmethod
    def of(cls, bins: list[int]) -> Codes:
        group, unit, used = [0] * len(bins), [1] * len(bins), []
        for f in sorted(range(len(bins)), key=lambda f: -bins[f]):
            g = next((g for g, n in enumerate(used) if n * bins[f] <= CODES), len(used))
            if g == len(used):
                used.append(1)
            group[f], unit[f] = g, used[g]
            used[g] *= bins[f]
        return cls(tuple(group), tuple(unit), tuple(bins), max(used))

    @property
    def n_groups(self) -> int:
        return max(self.group) + 1

    def bin_of(self, f: int) -> np.ndarray:
        """The feature's bin for every code of its group."""
        return np.arange(self.width) // self.unit[f] % self.bins[f]


@dataclass
class Tree:
    """Nodes in the order they were made. ``stats``: weight, sum, sum of squares and rows."""
    stats: list = field(default_factory=list)
    impurity: list = field(default_factory=list)
    gain: list = field(default_factory=list)
    split: list = field(default_factory=list)    # (feature, index of the candidate) or None
    child: list = field(default_factory=list)    # (left, right); itself twice for a leaf

    def add(self, stats: np.ndarray) -> int:
        self.stats.append(stats)
        self.impurity.append(float(_impurity(stats)))
        self.gain.append(-1.0)
        self.split.append(None)
        self.child.append((len(self.child),) * 2)
        return len(self.child) - 1

    def values(self) -> np.ndarray:
        s = np.array(self.stats)
        return np.divide(s[:, 1], s[:, 0], out=np.zeros(len(s)), where=s[:, 0] != 0)

    def routes(self, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every node: its group, whether a code goes right, its children."""
        group = np.array([codes.group[s[0]] if s else 0 for s in self.split], np.intp)
        right = np.zeros((len(group), codes.width), np.uint8)
        for node, s in enumerate(self.split):
            if s:
                right[node] = codes.bin_of(s[0]) > s[1]
        return group, right.ravel(), np.array(self.child, np.intp).ravel()


def _impurity(stats: np.ndarray) -> np.ndarray:
    """Variance from (weight, sum, sum of squares, ...), as Spark computes it."""
    n, s, q = stats[0], stats[1], stats[2]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (q - s * s / n) / n)


def _node_of(block: tuple, routes: tuple, steps: int) -> np.ndarray:
    """The node each row is at after ``steps`` splits."""
    codes, (group, right, child) = block[0], routes
    n = codes.shape[1]
    node, flat, width, row = np.zeros(n, np.intp), codes.ravel(), len(right) // len(group), np.arange(n)
    for _ in range(steps):
        code = flat.take(group.take(node) * n + row)
        node = child.take(2 * node + right.take(node * width + code))
    return node


def _residuals(y: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
    """What the next tree is fitted to: the labels first, then the negative gradient of Spark's log loss."""
    y = y.astype(float)
    if margin is None:
        return y
    with np.errstate(over="ignore"):
        return 4.0 * y / (1.0 + np.exp(2.0 * y * margin))


def _moved(block: tuple, margin: np.ndarray | None, routes: tuple, values: np.ndarray, step: float, depth: int) -> np.ndarray:
    """Margins with a tree added."""
    add = values[_node_of(block, routes, depth)] * step
    return add if margin is None else margin + add


def _sums(blocks: Iterator[tuple], codes: Codes, routes: tuple | None, level: int, slot: np.ndarray, n_slots: int) -> np.ndarray:
    """(4, slots, features, bins) sums over blocks of rows with their margins. ``slot``: the place of a node, -1 for none."""
    shape = (4, codes.n_groups, n_slots * codes.width)
    total = None
    for block, margin in blocks:
        coded, y, w = block
        r = _residuals(y, margin)
        at = slot[_node_of(block, routes, level)] if level else np.zeros(len(y), np.intp)
        pick = slice(None)
        if level and (at < 0).any():
            pick = np.flatnonzero(at >= 0)
            at, r, w = at[pick], r[pick], None if w is None else w[pick]
        wr = r if w is None else w * r
        wrr, base = wr * r, at * codes.width
        part = np.empty(shape)
        for g in range(shape[1]):
            key = base + coded[g][pick]
            part[3, g] = np.bincount(key, minlength=shape[2])
            part[0, g] = part[3, g] if w is None else np.bincount(key, w, shape[2])
            part[1, g] = np.bincount(key, wr, shape[2])
            part[2, g] = np.bincount(key, wrr, shape[2])
        total = part if total is None else total + part
    out = np.zeros((4, n_slots, len(codes.bins), max(codes.bins)))
    if total is None:
        return out
    total = total.reshape(4, -1, n_slots, codes.width)
    for f, (g, u, b) in enumerate(zip(codes.group, codes.unit, codes.bins)):
        used = codes.width // (u * b) * u * b
        cells = total[:, g, :, :used].reshape(4, n_slots, -1, b, u).sum((2, 4))
        out[:, :, f, :b] = cells + _rest(total[:, g, :, used:], codes.bin_of(f)[used:], b)
    return out


def _rest(cells: np.ndarray, bins: np.ndarray, n: int) -> np.ndarray:
    """Sums by bin of the codes behind the last whole turn of a feature's bins."""
    out = np.zeros((*cells.shape[:2], n))
    for i, b in enumerate(bins):
        out[:, :, b] += cells[:, :, i]
    return out


def _best(hist: np.ndarray, parents: np.ndarray, rules: Rules) -> list[tuple | None]:
    """For every node (gain, feature, candidate, left and right stats) of its best split, None where none is valid.
    The first of equal gains wins, features and candidates in order."""
    n_splits = np.array(rules.n_splits)
    cum = np.cumsum(hist, axis=3)
    left, right = cum[..., :-1], cum[..., -1:] - cum[..., :-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = left[0] + right[0]
        gain = (_impurity(parents)[:, None, None] - left[0] / weight * _impurity(left)
                - right[0] / weight * _impurity(right))
        valid = ((np.arange(left.shape[3]) < n_splits[:, None]) & (left[3] >= rules.min_rows) & (right[3] >= rules.min_rows)
                 & (left[0] >= rules.min_weight) & (right[0] >= rules.min_weight) & (gain >= rules.min_gain))
    gain = np.where(valid, gain, -np.inf).reshape(len(gain), -1)
    out = []
    for node, at in enumerate(gain.argmax(1) if gain.shape[1] else [0] * len(gain)):
        if not gain.shape[1] or gain[node, at] == -np.inf:
            out.append(None)
            continue
        f, s = divmod(int(at), left.shape[3])
        out.append((float(gain[node, at]), f, s, left[:, node, f, s].copy(), right[:, node, f, s].copy()))
    return out


def _root(hist: np.ndarray, rules: Rules) -> np.ndarray:
    """Stats of all rows, added up as Spark does: the first candidate's left side and the rest."""
    f = next((f for f, n in enumerate(rules.n_splits) if n), 0)
    left, whole = hist[:, 0, f, 0], np.cumsum(hist[:, 0, f], axis=1)[:, -1]
    return left + (whole - left)


def grow_tree(rules: Rules, codes: Codes, sums) -> Tree:
    """One tree; ``sums(routes, level, slot, n_slots)`` gives the sums of the nodes that have a slot."""
    tree, level, open_nodes = Tree(), 0, [0]
    hist = sums(None, 0, np.zeros(1, np.intp), 1)
    tree.add(_root(hist, rules))
    while open_nodes and level < rules.depth:
        found = _best(hist, np.array([tree.stats[i] for i in open_nodes]).T, rules)
        parents, pairs = [], []
        for at, (node, best) in enumerate(zip(open_nodes, found)):
            if best is None:
                tree.impurity[node] = -1.0
                continue
            gain, f, s, left, right = best
            if gain <= 0:
                continue
            tree.gain[node], tree.split[node] = gain, (f, s)
            tree.child[node] = (tree.add(left), tree.add(right))
            parents.append(at)
            pairs.append(tree.child[node])
        level += 1
        more = [[abs(tree.impurity[c]) >= EPSILON for c in pair] for pair in pairs]
        open_nodes = [c for pair, go in zip(pairs, more) for c, g in zip(pair, go) if g]
        if not open_nodes or level == rules.depth:
            break
        # the nodes that are summed: of two siblings that go on, the one with fewer rows
        small = [min(pair, key=lambda c: tree.stats[c][3]) for pair in pairs]
        asked = [c for pair, go, least in zip(pairs, more, small) for c, g in zip(pair, go)
                 if g and (c == least or not all(go))]
        slot = np.full(len(tree.child), -1, np.intp)
        slot[asked] = np.arange(len(asked))
        fresh = sums(tree.routes(codes), level, slot, len(asked))
        if len(asked) == len(open_nodes):
            hist = fresh
            continue
        parts = dict(zip(asked, np.moveaxis(fresh, 1, 0)))
        for at, pair in zip(parents, pairs):
            for c, other in (pair, pair[::-1]):
                if c in open_nodes and c not in parts:
                    parts[c] = hist[:, at] - parts[other]
        hist = np.stack([parts[c] for c in open_nodes], 1)
    return tree


def _grow_local(rows: list[tuple], rules: Rules, codes: Codes, n_trees: int, step: float) -> list[Tree]:
    """All trees of a table that is held in one place."""
    margins, trees = [None] * len(rows), []
    for t in range(n_trees):
        tree = grow_tree(rules, codes, lambda *a: _sums(zip(rows, margins), codes, *a))
        trees.append(tree)
        routes, values = tree.routes(codes), tree.values()
        margins = [_moved(b, m, routes, values, step if t else 1.0, rules.depth) for b, m in zip(rows, margins)]
    return trees


def _grow_apart(blocks: RDD, rules: Rules, codes: Codes, n_trees: int, step: float, interval: int) -> list[Tree]:
    """All trees of a table in parts. Margins are kept beside the rows and written every ``interval`` trees."""
    trees, margins, written = [], None, None
    for t in range(n_trees):
        pairs = blocks.map(lambda b: (b, None)) if margins is None else blocks.zip(margins)

        def sums(routes, level, slot, n_slots, pairs=pairs):
            parts = pairs.mapPartitions(lambda it: [_sums(it, codes, routes, level, slot, n_slots)])
            if parts.getNumPartitions() > MERGED:
                return parts.treeReduce(np.add, 2)
            return sum(parts.collect())

        tree = grow_tree(rules, codes, sums)
        trees.append(tree)
        if margins is not None and margins.isCheckpointed():
            _drop(written)
            written = margins
        if t + 1 < n_trees:
            routes, values, by, depth = tree.routes(codes), tree.values(), step if t else 1.0, rules.depth
            before, margins = margins, _kept(pairs.map(
                lambda x, r=routes, v=values, by=by, d=depth: _moved(x[0], x[1], r, v, by, d)))
            if interval > 0 and t % interval == interval - 1:
                margins.checkpoint()
            if before is not None:
                margins.count()  # held before what it was made from goes
                before.unpersist()
    if margins is not None:
        margins.unpersist()
    _drop(written)
    return trees


def _kept(rdd: RDD) -> RDD:
    """Held by Spark, one element at a time, so that ``zip`` takes it as it is."""
    from pyspark import StorageLevel

    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1)).persist(StorageLevel.MEMORY_AND_DISK)


def _drop(rdd: RDD | None) -> None:
    """Removes the checkpoint of margins that newer ones have replaced."""
    if rdd is not None and rdd.getCheckpointFile():
        path = rdd.ctx._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile())
        path.getFileSystem(rdd.ctx._jsc.hadoopConfiguration()).delete(path, True)


def _module(jvm, name: str):
    return jvm.java.lang.Class.forName(f"{name}$").getField("MODULE$").get(None)


def _candidates(est: GBTClassifier, df: DataFrame) -> tuple[list[np.ndarray], int, float]:
    """Spark's split candidates for each feature, its number of rows and their weight. Checks labels, weights and
    features as Spark's fit does."""
    sc, java = df.sparkSession.sparkContext, est._to_java()
    jvm, impl = sc._jvm, "org.apache.spark.ml.tree.impl"
    found = _module(jvm, "org.apache.spark.ml.util.DatasetUtils").extractInstances(java, df._jdf, jvm.scala.Option.apply(2))
    algo = _module(jvm, "org.apache.spark.mllib.tree.configuration.Algo")
    none = _module(jvm, "scala.collection.immutable.Map").empty()
    strategy = java.getOldBoostingStrategy(none, algo.Classification()).treeStrategy().copy()
    getattr(strategy, "algo_$eq")(algo.Regression())
    getattr(strategy, "impurity_$eq")(_module(jvm, "org.apache.spark.mllib.tree.impurity.Variance"))
    meta = _module(jvm, f"{impl}.DecisionTreeMetadata").buildMetadata(found, strategy, 1, est.getFeatureSubsetStrategy())
    splits = _module(jvm, f"{impl}.RandomForest").findSplits(found, meta, est.getSeed())
    thresholds = [np.array([s.threshold() for s in of]) for of in splits]
    return thresholds, int(meta.numExamples()), float(meta.weightedNumExamples())


def _binned(df: DataFrame, est: GBTClassifier, thresholds: list[np.ndarray], codes: Codes) -> RDD:
    """Blocks (codes of every group, labels -1 and 1, weights or None) of all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        coded = np.zeros((codes.n_groups, len(x)), np.uint8)
        for f, t in enumerate(thresholds):
            coded[codes.group[f]] += (np.searchsorted(t, x[:, f]) * codes.unit[f]).astype(np.uint8)
        y = (2.0 * table.column("y").to_numpy() - 1.0).astype(np.int8)
        w = table.column("w").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (coded, y, w)], names=["x", "y", "w"])

    weighted = est.isDefined("weightCol") and bool(est.getWeightCol())
    weight = F.col(f"`{est.getWeightCol()}`").cast("double") if weighted else F.lit(1.0)
    groups = codes.n_groups
    rows = df.select(vector_to_array(F.col(est.getFeaturesCol())).alias("x"), F.col(est.getLabelCol()).cast("double").alias("y"),
                     weight.alias("w"))
    return rows.mapInArrow(run, "x binary, y binary, w binary").rdd.map(lambda r: (
        np.frombuffer(r[0], np.uint8).reshape(groups, -1), np.frombuffer(r[1], np.int8), np.frombuffer(r[2]) if weighted else None))


def _nodes(tree: Tree, thresholds: list[np.ndarray]) -> list[tuple]:
    """Spark's rows of a tree, parents before their children; siblings that are leaves of one value become one leaf."""
    value, leaf = tree.values().tolist(), {}

    def is_leaf(i: int) -> bool:
        if i not in leaf:
            a, b = tree.child[i]
            leaf[i] = a == i or (is_leaf(a) and is_leaf(b) and value[a] == value[b])
        return leaf[i]

    def shown(i: int) -> float:
        return value[i] if tree.child[i][0] == i else shown(tree.child[i][0])

    out = []

    def put(i: int) -> None:
        stats, here = tree.stats[i], len(out)
        head = [[float(v) for v in stats[:3]], int(stats[3])]
        if is_leaf(i):
            out.append((here, shown(i), tree.impurity[i], *head, -1.0, -1, -1, (-1, [], -1)))
            return
        out.append(None)
        f, s = tree.split[i]
        put(tree.child[i][0])
        right = len(out)
        put(tree.child[i][1])
        out[here] = (here, value[i], tree.impurity[i], *head, tree.gain[i], here + 1, right,
                     (f, [float(thresholds[f][s])], -1))

    put(0)
    return out


def _as_model(df: DataFrame, est: GBTClassifier, trees: list[Tree], thresholds: list[np.ndarray]) -> GBTClassificationModel:
    """Spark's model of the trees, by way of its saved form."""
    spark = df.sparkSession
    path = scratch_path(spark, "grown")
    names = [{p.name: v for p, v in m.items()} for m in (est._paramMap, est._defaultParamMap)]

    def meta(kind: str, uid: str, keep=None, **more) -> str:
        own = [{k: v for k, v in m.items() if keep is None or k in keep} for m in names]
        return json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000),
                           "sparkVersion": spark.version, "uid": uid, "paramMap": own[0], "defaultParamMap": own[1], **more})

    spark.createDataFrame([(meta("classification.GBTClassificationModel", est.uid, numFeatures=len(thresholds),
                                 numTrees=len(trees)),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(
        [(t, meta("regression.DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", TREE_PARAMS),
          est.getStepSize() if t else 1.0) for t in range(len(trees))],
        "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    rows = [(t, n) for t, tree in enumerate(trees) for n in _nodes(tree, thresholds)]
    spark.createDataFrame(rows, NODES, verifySchema=False).coalesce(1).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)


def fit(est, df: DataFrame):
    """The fit of any estimator on ``df``: grown here where that is the same job, Spark's own otherwise."""
    return grow(est, df) if can_grow(est, df) and df.count() > SMALL_ROWS else est.fit(df)


def grow(est: GBTClassifier, df: DataFrame) -> GBTClassificationModel:
    """The fit of ``est`` on ``df``: label, weight and feature vector columns as the estimator names them."""
    ensure_checkpoint_dir(df.sparkSession)
    thresholds, n_rows, weight = _candidates(est, df)
    rules = Rules(est.getMaxDepth(), est.getMinInstancesPerNode(), est.getMinWeightFractionPerNode() * weight,
                  est.getMinInfoGain(), tuple(map(len, thresholds)))
    codes = Codes.of([len(t) + 1 for t in thresholds])
    blocks, n_trees, step = _kept(_binned(df, est, thresholds, codes)), est.getMaxIter(), est.getStepSize()
    try:
        blocks.count()  # binned in all parts at once
        if n_rows <= LOCAL_ROWS:
            trees = blocks.coalesce(1).mapPartitions(
                lambda it: _grow_local(list(it), rules, codes, n_trees, step)).collect()
        else:
            trees = _grow_apart(blocks, rules, codes, n_trees, step, est.getCheckpointInterval())
    finally:
        blocks.unpersist()
    return _as_model(df, est, trees, thresholds)
