"""Leaf values of a fitted boosted ensemble: L2-regularised refit, scores of all its prefixes, the best one.

Spark's trees stay as they are; what is new are the values of their leaves. One transform writes the leaf of
every row in every tree; a tree's new values come from sums of gradients and Hessians by leaf, tree by tree,
each on the margins of the trees before it. Scores of every prefix are running sums over the trees of one
row, so a validation table is read once for all prefixes.

Margins are log-odds. Spark's own are half of that (its loss has a factor two), so its leaf values come in
here doubled. Rows with a NULL feature raise, as in the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credora.operators.running import prefix_sums
from credora.session import scratch_path

BLOCK = 25  # trees whose leaves travel together while they are refitted


def leaf_values(model: PipelineModel) -> np.ndarray:
    """(trees, leaves) values of a fitted ensemble on the log-odds scale, tree weights included; leaves in
    the order of Spark's leaf column, rows padded with 0. Read from the saved form: one small table."""
    trees, session = model.stages[-1], SparkSession.getActiveSession()
    path = scratch_path(session, "trees")
    trees.write().overwrite().save(path)
    nodes = session.read.parquet(f"{path}/data")
    rows = (nodes.select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild")
            .filter("leftChild < 0").orderBy("treeID", "id").collect())
    values = [[] for _ in range(trees.getNumTrees)]
    for r in rows:
        values[r["treeID"]].append(r["prediction"])
    out = np.zeros((len(values), max(map(len, values), default=1)))
    for t, (v, w) in enumerate(zip(values, trees.treeWeights)):
        out[t, :len(v)] = 2 * w * np.array(v)
    return out


def with_leaves(model: PipelineModel, df: DataFrame, col: str = "leaves") -> DataFrame:
    """``df`` with the leaf numbers of every row, one for each tree."""
    trees = model.stages[-1]
    marked = trees.copy({trees.leafCol: "_leaf"})
    ready = len(model.stages) == 1 or trees.getFeaturesCol() in df.columns
    assembled = df if ready else model.stages[0].transform(df)
    drop = [trees.getFeaturesCol(), trees.getRawPredictionCol(), trees.getProbabilityCol(),
            trees.getPredictionCol(), "_leaf"]
    return marked.transform(assembled).withColumn(
        col, vector_to_array("_leaf").cast("array<int>")).drop(*drop)


def _leaf_matrix(batch: pa.RecordBatch, column: str = "leaves") -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _picked(values: np.ndarray, leaves: np.ndarray, first: int = 0) -> np.ndarray:
    """Each row's value in each tree (columns from tree ``first`` on)."""
    return values[np.arange(first, first + leaves.shape[1]), leaves]


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(f, -500, 500)))


@dataclass
class LeafModel:
    """A fitted ensemble whose first ``n_trees`` trees count, with leaf values of its own."""
    model: PipelineModel
    values: np.ndarray
    n_trees: int
    base: float = 0.0

    def predict(self, df: DataFrame, keep: list[str] | None = None, threshold: float = 0.5,
                score_col: str = "score", pred_col: str = "prediction") -> DataFrame:
        keep = list(keep or [])
        kinds = dict(df.dtypes)
        values, base = self.values[:self.n_trees], self.base

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaves = _leaf_matrix(batch)[:, :len(values)]
                score = _sigmoid(base + _picked(values, leaves).sum(1))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep], pa.array(score), pa.array((score > threshold).astype(float))],
                    names=[*keep, score_col, pred_col])

        rows = with_leaves(self.model, df).select(*[F.col(f"`{c}`") for c in keep], "leaves")
        schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{score_col}` double", f"`{pred_col}` double"])
        return rows.mapInArrow(run, schema)

    def save(self, path: str) -> dict:
        """Write the ensemble; returns what ``load`` needs besides it."""
        self.model.write().overwrite().save(path)
        return {"values": self.values.tolist(), "n_trees": self.n_trees, "base": self.base}

    @classmethod
    def load(cls, path: str, saved: dict) -> LeafModel:
        return cls(PipelineModel.load(path), np.array(saved["values"]), saved["n_trees"], saved["base"])


def as_fitted(model: PipelineModel) -> LeafModel:
    """The ensemble with its own leaf values: the same scores as Spark's transform."""
    values = leaf_values(model)
    return LeafModel(model, values, len(values))


def refit_leaves(model: PipelineModel, train: DataFrame, label: str = "loan_status", l2: float = 2.5,
                 step: float | None = None, weight_col: str | None = None) -> LeafModel:
    """Newton values with an L2 term for every leaf, tree by tree: -step G / (H + l2), where G and H sum the
    gradients and Hessians of the log loss of the leaf's rows at the margin of the trees before. The margin
    starts at the log-odds of the label; a leaf without rows gets 0."""
    trees = model.stages[-1]
    step = trees.getStepSize() if step is None else step
    shape = leaf_values(model).shape
    weight = F.lit(1.0) if weight_col is None else F.col(weight_col).cast("double")
    kind = "tinyint" if shape[1] <= 2**7 else "smallint" if shape[1] <= 2**15 else "int"
    # written once, one byte for a leaf: blocks read it, and nothing writes it again
    rows = with_leaves(model, train).select(
        F.col(label).cast("double").alias("y"), weight.alias("w"), F.col("leaves").cast(f"array<{kind}>")).coalesce(
        train.sparkSession.sparkContext.defaultParallelism).checkpoint()
    sums = rows.agg(F.sum(F.col("w") * F.col("y")).alias("one"), F.sum("w").alias("all")).first()
    one, everything = sums["one"] or 0.0, sums["all"] or 0.0
    base = float(np.log(one / (everything - one))) if 0 < one < everything else 0.0
    values = np.zeros(shape)
    for first in range(0, shape[0], BLOCK):
        last = min(first + BLOCK, shape[0])
        block = _packed(rows, values[:first], base, last).checkpoint()
        for t in range(first, last):
            values[t] = _newton(block, values[first:t], shape[1], l2, step)
    return LeafModel(model, values, shape[0], base)


def _packed(rows: DataFrame, before: np.ndarray, base: float, last: int) -> DataFrame:
    """The trees behind ``before`` up to ``last``: one row for a batch of rows, with their labels, weights, margins
    of the trees before and leaf numbers, tree by tree."""
    first = len(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            leaves = _leaf_matrix(batch)
            margins = base + _picked(before, leaves[:, :first]).sum(1)
            parts = [batch.column("y").to_numpy(), batch.column("w").to_numpy(), margins,
                     leaves[:, first:].T.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts],
                                             names=["y", "w", "f", "leaves"])

    return rows.select("y", "w", F.slice("leaves", 1, last).alias("leaves")).mapInArrow(
        run, "y binary, w binary, f binary, leaves binary")


def _newton(block: DataFrame, before: np.ndarray, n_leaves: int, l2: float, step: float) -> np.ndarray:
    """New values of the block's tree behind ``before``. The tasks' sums by leaf are added up as they come."""
    t = len(before)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n_leaves))
        for batch in batches:
            for i in range(batch.num_rows):
                y, w, f = (np.frombuffer(batch.column(c)[i].as_buffer()) for c in ("y", "w", "f"))
                leaves = np.frombuffer(batch.column("leaves")[i].as_buffer(), np.int32).reshape(-1, len(y))
                p = _sigmoid(f + sum(v[leaf] for v, leaf in zip(before, leaves)))
                total[0] += np.bincount(leaves[t], w * (p - y), n_leaves)
                total[1] += np.bincount(leaves[t], w * p * (1 - p), n_leaves)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["sums"])

    found = [r["sums"] for r in block.mapInArrow(sums, "sums array<double>").collect()]
    g, h = np.sum(np.array(found, float).reshape(-1, 2, n_leaves), axis=0)
    return np.divide(-step * g, h + l2, out=np.zeros(n_leaves), where=h + l2 > 0)


def staged_auc(model: LeafModel, valid: DataFrame, label: str = "loan_status") -> DataFrame:
    """(n_trees, auc) of every prefix of the ensemble: AUC with ties, NULL where a class is missing. Each
    task adds up its rows' prefixes and counts them by score; ranks come from bucketed running sums."""
    values, base = model.values, model.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                y = part.column("y").to_numpy()
                f = base + np.cumsum(_picked(values, _leaf_matrix(part)), axis=1)
                n, score, one, zero = [], [], [], []
                for t in range(f.shape[1]):
                    own, at = np.unique(f[:, t], return_inverse=True)
                    n.append(np.full(len(own), t + 1))
                    score.append(own)
                    one.append(np.bincount(at, y == 1, len(own)))
                    zero.append(np.bincount(at, y != 1, len(own)))
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(n)), pa.array(np.concatenate(score)),
                         pa.array(np.concatenate(one).astype(np.int64)), pa.array(np.concatenate(zero).astype(np.int64))],
                        names=["n_trees", "score", "one", "zero"])

    rows = with_leaves(model.model, valid).select(F.col(label).cast("double").alias("y"), "leaves")
    counts = (rows.mapInArrow(run, "n_trees long, score double, one long, zero long")
              .groupBy("n_trees", "score").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero")))
    ranked = prefix_sums(counts.checkpoint(), ["score"], ["zero"], ["n_trees"])
    won = F.sum(F.col("one") * (F.col("zero_before") + F.col("zero") / 2))
    return (ranked.groupBy("n_trees").agg(won.alias("won"), F.sum("one").alias("ones"), F.sum("zero").alias("zeros"))
            .select("n_trees", F.try_divide("won", F.col("ones") * F.col("zeros")).alias("auc")))


def best_prefix(model: LeafModel, valid: DataFrame, label: str = "loan_status") -> tuple[LeafModel, float | None]:
    """The ensemble cut behind the prefix of the highest AUC on ``valid`` (ties: the shortest), and that AUC."""
    best = staged_auc(model, valid, label).orderBy(F.desc_nulls_last("auc"), "n_trees").first()
    if best is None or best["auc"] is None:
        return model, None
    return LeafModel(model.model, model.values, int(best["n_trees"]), model.base), best["auc"]
