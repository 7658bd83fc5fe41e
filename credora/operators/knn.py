"""Exact k-nearest neighbours by a k-d tree over the cluster, and SMOTE on top.

No all-pairs join, in any number of dimensions:

1. Exact duplicates collapse to one group (key: the coordinates) that keeps its k+1
   smallest ids, found with a salted two-step top-k so a group holding a third of the
   rows is still ranked in many tasks.
2. A sample of the groups is cut at medians until a leaf stands for less than ``BLOCK``
   groups. The cuts decide only where a group goes; every group goes down the tree. Leaves
   of more than ``BLOCK`` groups are cut into blocks by hash.
3. Inside its own block every group finds its k+1 nearest, an upper bound for its (k+1)-th
   distance. A block also gives the box around its members.
4. A group then visits only the blocks whose box is within its bound. Each visit returns
   at most k+1 groups within it, and one window takes the best of all visits.
5. Members get their group's list minus themselves (salted join for hot groups).

The size of a block does not depend on the number of groups (until the sample reaches
``SAMPLE_VALUES``), so the work grows with the rows and with the number of boxes that a bound
touches; there are no levels and no limits that could leave a group unanswered. Distances are
computed with NumPy in blocks. Ties are broken by id, so the result is the unique k smallest
(distance, id).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credora.operators.sample import hash_rank

SALTS = 16
BLOCK = 1000              # groups in a block of a leaf (max_cell)
LEAF_SAMPLE = 16          # sampled groups in a leaf, at most
SAMPLE_VALUES = 4_000_000  # coordinates of the sample, held by the driver while it cuts
VISITS = 20_000           # visiting groups that one task compares with a block
PAIRS = 2_000_000         # distances held at once in a task


def _sq_dists(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, summed in column order."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        out += gap * gap
    return out


def _sq_to_boxes(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes, summed in column order: rounding keeps them at or below
    those to anything inside. ``x`` may be a pair (lows, highs) of boxes itself."""
    x_low, x_high = x if isinstance(x, tuple) else (x, x)
    out = np.zeros((len(x_low), len(low)))
    for j in range(low.shape[1]):
        gap = np.fmax(np.fmax(low[None, :, j] - x_high[:, j, None], x_low[:, j, None] - high[None, :, j]), 0)
        out += gap * gap
    return out


def _chunks(n: int, width: int) -> Iterator[slice]:
    step = max(1, PAIRS // max(1, width))
    for begin in range(0, n, step):
        yield slice(begin, begin + step)


def _within(d2: np.ndarray, bound: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the m smallest distances of each row that are not above its bound, ties by column."""
    row, col = np.nonzero(d2 <= bound[:, None])
    order = np.lexsort((col, d2[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < m], col[place < m]


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """Rows of an array column as a matrix."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in parts]
    return (np.concatenate(flat) if flat else np.empty(0)).astype(float, copy=False).reshape(-1, d)


def _lists(values: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as an array column."""
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d)[:n + 1] if d else np.zeros(n + 1), pa.int32()),
                                    pa.array(np.ascontiguousarray(values).ravel()))


def _spread(ids: np.ndarray) -> np.ndarray:
    """A hash of each id in 32 bits."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)


def _cut_tree(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(column, cut, child, leaf) for each node: values up to the cut go to ``child``, others to the node
    behind it; leaves have column -1 and a number. Nodes are cut at the median of their most varied column."""
    column, cut, child, leaf = [], [], [], []
    n_leaves = 0
    level = [np.arange(len(sample))]
    while level:  # level by level: a node's children stand side by side
        behind, after = [], len(column) + len(level)
        for rows in level:
            x = sample[rows]
            best = int(np.argmax(x.var(axis=0))) if len(rows) > LEAF_SAMPLE else -1
            v = x[:, best]
            if best < 0 or v.min() == v.max():
                column.append(-1), cut.append(0.0), child.append(-1), leaf.append(n_leaves)
                n_leaves += 1
                continue
            at = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
            at = at if at < v.max() else v[v < at].max()
            column.append(best), cut.append(float(at)), child.append(after + len(behind)), leaf.append(-1)
            behind += [rows[v <= at], rows[v > at]]
        level = behind
    return np.array(column), np.array(cut), np.array(child), np.array(leaf)


def _descend(x: np.ndarray, tree: tuple) -> np.ndarray:
    """The leaf of each row."""
    column, cut, child, leaf = tree
    node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    while True:
        rows = rows[column[node[rows]] >= 0]
        if not len(rows):
            return leaf[node].astype(np.int32)
        at = node[rows]
        node[rows] = child[at] + ~(x[rows, column[at]] <= cut[at])


def knn(df: DataFrame, cols: list[str], k: int = 5, id_col: str = "id",
        max_cell: int = BLOCK, salts: int = SALTS) -> DataFrame:
    """(id, nn_rank, nn_id, dist): the k nearest other rows of every row (Euclidean over
    ``cols``, rows with a NULL or NaN coordinate or without an id skipped), ties by smaller id."""
    from credora.session import ensure_checkpoint_dir

    spark, d = df.sparkSession, len(cols)
    ensure_checkpoint_dir(spark)
    complete = F.col(id_col).isNotNull()
    for c in cols:
        complete = complete & F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double"))
    # coordinates travel as one array column: few attributes keep planning cheap in any d
    pts = df.where(complete).select(F.col(id_col).alias("_id"),
                                    F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("_vec"))

    # 1. duplicate groups -> k+1 smallest ids each (salted two-step top-k)
    salted = pts.withColumn("_s", F.pmod(F.xxhash64("_id"), F.lit(salts)))
    first = Window.partitionBy("_vec", "_s").orderBy("_id")
    part = salted.withColumn("_r1", F.row_number().over(first)).where(F.col("_r1") <= k + 1)
    tops = part.withColumn("_pos", F.row_number().over(Window.partitionBy("_vec").orderBy("_id"))) \
        .where(F.col("_pos") <= k + 1) \
        .withColumn("_gid", F.min("_id").over(Window.partitionBy("_vec")).cast("long")) \
        .select("_gid", "_id", "_pos", "_vec").checkpoint()
    groups = tops.where(F.col("_pos") == 1).select("_gid", "_vec")
    tops = tops.select("_gid", F.col("_id").alias("_nid"))
    n = groups.count()
    if n == 0:
        return spark.createDataFrame([], f"{id_col} long, nn_rank int, nn_id long, dist double")

    # 2. leaves of a tree cut from a sample of bounded size; leaves are cut into blocks by hash
    share = min(1.0, LEAF_SAMPLE / (0.75 * max_cell), SAMPLE_VALUES / (n * d))
    chosen = groups.where(F.pmod(F.xxhash64("_gid"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    tree = _cut_tree(_matrix(chosen.select("_vec").toArrow()["_vec"], d))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = _descend(_matrix(b.column("_vec"), d), tree)
            yield pa.RecordBatch.from_arrays([b.column("_gid"), b.column("_vec"), pa.array(cell)],
                                             names=["_gid", "_vec", "_cell"])

    placed = groups.mapInArrow(assign, "_gid long, _vec array<double>, _cell int").checkpoint()
    blocks = np.ones(len(tree[0]), dtype=np.int64)
    for r in placed.groupBy("_cell").count().collect():  # one row for each leaf
        blocks[r["_cell"]] = math.ceil(r["count"] / max_cell)
    first_block = np.cumsum(blocks) - blocks

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, gid = b.column("_cell").to_numpy(), b.column("_gid").to_numpy()
            block = first_block[cell] + (_spread(gid) % blocks[cell].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("_gid"), b.column("_vec"), pa.array(block.astype(np.int32))],
                                             names=["_gid", "_vec", "_block"])

    # 3. the k+1 nearest in the own block, the bound from them, and the block's box (in its first row)
    def own(there: pa.Table) -> pa.Table:
        there = there.sort_by("_gid")
        x, ids = _matrix(there["_vec"], d), there["_gid"].to_numpy()
        tau, near, dist = np.full(len(x), np.inf), [], []
        sizes = np.zeros(len(x), dtype=np.int64)
        for s in _chunks(len(x), len(x)):
            d2 = _sq_dists(x[s], x)
            if d2.shape[1] > k:
                tau[s] = np.partition(d2, k, axis=1)[:, k]
            row, col = _within(d2, tau[s], k + 1)
            sizes[s] = np.bincount(row, minlength=len(d2))
            near.append(ids[col])
            dist.append(d2[row, col])
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        rest = [None] * (len(x) - 1)
        return pa.table({
            "_gid": there["_gid"], "_vec": there["_vec"], "_block": there["_block"], "_tau2": pa.array(tau),
            "_v": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(near))),
            "_d2": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(dist))),
            "_low": pa.array([x.min(axis=0).tolist(), *rest], pa.list_(pa.float64())),
            "_high": pa.array([x.max(axis=0).tolist(), *rest], pa.list_(pa.float64())),
            "_n": pa.array([len(x), *rest], pa.int64())})

    bounded = placed.mapInArrow(cut, "_gid long, _vec array<double>, _block int") \
        .groupBy("_block").applyInArrow(
            own, "_gid long, _vec array<double>, _block int, _tau2 double, _v array<long>, _d2 array<double>, "
                 "_low array<double>, _high array<double>, _n long").checkpoint()
    boxes = bounded.where(F.col("_n").isNotNull()).select("_block", "_n", "_low", "_high").toArrow()
    number, counts = boxes["_block"].to_numpy(), boxes["_n"].to_numpy()
    low, high = _matrix(boxes["_low"], d), _matrix(boxes["_high"], d)

    # 4. visits
    def farthest(x: np.ndarray) -> np.ndarray:
        """A bound for rows of blocks of at most k groups: boxes that hold k+1 groups, by their far corners."""
        out = np.full(len(x), np.inf)
        if counts.sum() > k:
            for i, p in enumerate(x):
                far = np.fmax(np.abs(p - low), np.abs(p - high))
                far = sum(far[:, j] * far[:, j] for j in range(d))
                order = np.argsort(far, kind="stable")
                out[i] = far[order][np.searchsorted(np.cumsum(counts[order]), k + 1)]
        return out

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, tau, home = _matrix(b.column("_vec"), d), b.column("_tau2").to_numpy().copy(), b.column("_block").to_numpy()
            gid, endless = b.column("_gid").to_numpy(), np.isinf(tau)
            tau[endless] = farthest(x[endless])
            order = np.argsort(home, kind="stable")
            edges = np.flatnonzero(np.diff(home[order], prepend=-1, append=-1))
            for begin, end in zip(edges[:-1], edges[1:]):  # rows of one block meet the same few boxes
                rows = order[begin:end]
                mine = x[rows]
                gap = _sq_to_boxes((mine.min(axis=0)[None], mine.max(axis=0)[None]), low, high)[0]
                some = np.flatnonzero((gap <= tau[rows].max()) & (number != home[rows[0]]))
                for s in _chunks(len(rows), len(some)):
                    q, c = np.nonzero(_sq_to_boxes(mine[s], low[some], high[some]) <= tau[rows[s], None])
                    if len(q):
                        asking = rows[s][q]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(number[some[c]], pa.int32()), pa.array(gid[asking]), _lists(x[asking]),
                             pa.array(tau[asking])], names=["_block", "_gid", "_vec", "_tau2"])

    visits = bounded.select("_gid", "_vec", "_block", "_tau2") \
        .mapInArrow(route, "_block int, _gid long, _vec array<double>, _tau2 double").checkpoint()
    # a block with many visitors is compared in several tasks
    tasks = np.zeros(int(blocks.sum()) + 1, dtype=np.int64)
    for r in visits.groupBy("_block").count().collect():  # one row for each block
        tasks[r["_block"]] = math.ceil(r["count"] / VISITS)
    first_task = np.cumsum(tasks) - tasks

    def visitor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, gid = b.column("_block").to_numpy(), b.column("_gid").to_numpy()
            task = first_task[block] + (_spread(gid) % tasks[block].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(task), b.column("_gid"), b.column("_vec"), b.column("_tau2")],
                                             names=["_task", "_gid", "_vec", "_tau2"])

    def host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = b.column("_block").to_numpy()
            times = tasks[block]
            at = np.repeat(np.arange(len(block)), times)
            task = first_task[block][at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays([pa.array(task), b.column("_gid").take(pa.array(at)),
                                              b.column("_vec").take(pa.array(at))], names=["_task", "_gid", "_vec"])

    def compare(asking: pa.Table, there: pa.Table) -> pa.Table:
        there = there.sort_by("_gid")
        x, ids = _matrix(there["_vec"], d), there["_gid"].to_numpy()
        q, names, tau = _matrix(asking["_vec"], d), asking["_gid"].to_numpy(), asking["_tau2"].to_numpy()
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for s in _chunks(len(q), len(x)):
            d2 = _sq_dists(q[s], x)
            row, col = _within(d2, tau[s], k + 1)
            out.append((names[s][row], ids[col], d2[row, col]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["_q", "_v", "_d2"])

    asking = visits.mapInArrow(visitor, "_task long, _gid long, _vec array<double>, _tau2 double")
    hosts = bounded.select("_block", "_gid", "_vec").mapInArrow(host, "_task long, _gid long, _vec array<double>")
    found = asking.groupBy("_task").cogroup(hosts.groupBy("_task")).applyInArrow(
        compare, "_q long, _v long, _d2 double")
    at_home = bounded.select(F.col("_gid").alias("_q"), F.explode(F.arrays_zip("_v", "_d2")).alias("_o")) \
        .select("_q", "_o._v", "_o._d2")
    # a group's k+1 nearest members are in its k+1 nearest groups by (distance, smallest id)
    near = at_home.unionByName(found) \
        .withColumn("_g", F.row_number().over(Window.partitionBy("_q").orderBy("_d2", "_v"))) \
        .where(F.col("_g") <= k + 1)
    cand = near.join(tops, F.col("_v") == F.col("_gid")).select("_q", "_nid", "_d2")
    lists = cand.withColumn("_rank", F.row_number().over(Window.partitionBy("_q").orderBy("_d2", "_nid"))) \
        .where(F.col("_rank") <= k + 1).checkpoint()

    # 5. members: the group's list minus themselves; hot groups salted over SALTS tasks
    members = pts.join(groups, "_vec") \
        .select("_id", "_gid", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_s"))
    rep = lists.select(F.col("_q").alias("_gid"), "_rank", "_nid", "_d2",
                       F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"))
    j = members.join(rep, ["_gid", "_s"]).where(F.col("_nid") != F.col("_id"))
    out = j.withColumn("nn_rank", F.row_number().over(Window.partitionBy("_id").orderBy("_rank"))) \
        .where(F.col("nn_rank") <= k)
    return out.select(F.col("_id").alias(id_col), "nn_rank", F.col("_nid").alias("nn_id"),
                      F.sqrt("_d2").alias("dist"))


def smote(df: DataFrame, cols: list[str], label: str = "loan_status", minority=1,
          ratio: float = 0.5, k: int = 5, seed=42, id_col: str = "id") -> DataFrame:
    """Append synthetic minority rows until minority = ratio x majority.

    Each new row is ``x + u * (neighbour - x)`` for one of the k nearest minority
    neighbours of a minority row x. Base rows are used round-robin in hash order
    (every row ``floor(new / n)`` times, the first ``new mod n`` once more); the
    neighbour and u come from md5 of (seed, id, copy), so the output is repeatable and
    independent of partitioning. Minority rows with a NULL coordinate count towards the
    share but are no base rows (n is the number of complete ones), so the number of new
    rows is always the number due. Output: (id, cols..., label, synthetic); synthetic ids
    are negative."""
    from credora.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    y = F.col(label)
    # written once: counts, neighbours, ranks and the output are passes over these columns only
    base = df.select(id_col, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols], label).checkpoint()
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(f"`{c}`").isNotNull()
    counts = {r["c"]: (r["n"], r["m"]) for r in base.groupBy(y.alias("c")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(complete).alias("m")).collect()}
    n_min, n_base = counts.get(minority, (0, 0))
    n_maj = max([v for c, (v, _) in counts.items() if c is not None and c != minority] + [0])
    new = int(n_maj * ratio - n_min)
    if new < 0:
        raise ValueError("minority already above the requested ratio: nothing to generate")
    if n_base <= k:
        raise ValueError(f"need more than k={k} minority rows, got {n_base}")
    mino = base.where((y == F.lit(minority)) & complete)
    nn = knn(mino, cols, k, id_col)
    ranked = hash_rank(mino, id_col, None, seed)
    q, rem = divmod(new, n_base)
    copies = F.lit(q) + F.when(F.col("_rank0") < rem, 1).otherwise(0)
    gen = ranked.where(copies > 0).select(
        id_col, "_rank0", *cols, F.explode(F.sequence(F.lit(0), copies - 1)).alias("_j"))
    h = F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string"), F.lit("-"),
                       F.col("_j").cast("string")))
    gen = gen.select("*", (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % k + 1)
                     .cast("int").alias("nn_rank"),
                     (F.conv(F.substring(h, 9, 8), 16, 10).cast("double") / 4294967296.0).alias("_u"))
    nbr = mino.select(F.col(id_col).alias("nn_id"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    syn = gen.join(nn.select(id_col, "nn_rank", "nn_id"), [id_col, "nn_rank"]).join(nbr, "nn_id")
    syn = syn.select(
        (-(F.lit(1) + F.col("_rank0") + F.col("_j") * F.lit(n_base))).cast("long").alias(id_col),
        *[(F.col(c) + F.col("_u") * (F.col(f"_n_{c}") - F.col(c))).alias(c) for c in cols],
        F.lit(minority).cast(dict(df.dtypes)[label]).alias(label),
        F.lit(1).alias("synthetic"))
    return base.withColumn("synthetic", F.lit(0)).unionByName(syn)
