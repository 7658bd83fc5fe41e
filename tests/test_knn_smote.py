import numpy as np
import pytest

from credora.operators.knn import knn, smote


def _brute(ids, X, k):
    d2 = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    out = {}
    for a in range(len(ids)):
        order = sorted((d2[a, b], ids[b]) for b in range(len(ids)) if b != a)[:k]
        out[ids[a]] = [i for _, i in order]
    return out


@pytest.mark.parametrize("dims", [2, 5])
def test_knn_exact_with_duplicates_and_hot_cluster(spark, dims):
    rng = np.random.default_rng(dims)
    X = np.concatenate([rng.normal(size=(300, dims)),
                        np.zeros((120, dims)),                       # a hot duplicate group
                        rng.normal(scale=1e-4, size=(150, dims)) + 3,  # a dense cluster
                        rng.normal(scale=20, size=(30, dims))])        # sparse outliers
    ids = np.arange(1, len(X) + 1) * 7
    cols = [f"x{i}" for i in range(dims)]
    df = spark.createDataFrame([(int(i), *map(float, x)) for i, x in zip(ids, X)],
                               ", ".join(["id long"] + [f"{c} double" for c in cols]))
    got = {}
    for r in knn(df, cols, 5, max_cell=40).collect():
        got.setdefault(r["id"], []).append((r["nn_rank"], r["nn_id"]))
    want = _brute(ids.tolist(), X, 5)
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == want


def test_smote_rows_on_segments_and_refusals(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(rng.normal()), float(rng.normal()), int(i % 5 == 0)) for i in range(1, 401)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y long")
    out = smote(df, ["a", "b"], "y", 1, 0.5, 5, 42).toPandas()
    syn = out[out.synthetic == 1]
    assert len(syn) == int(320 * 0.5 - 80)
    mino = {r[0]: np.array(r[1:3]) for r in rows if r[3] == 1}
    pts = np.array(list(mino.values()))
    for _, s in syn.iterrows():   # each synthetic row lies on a segment between two minority rows
        p = np.array([s.a, s.b])
        best = min(np.linalg.norm(np.cross(np.append(q - p, 0), np.append(r - p, 0)))
                   for q in pts for r in pts if np.dot(q - p, r - p) <= 1e-12)
        assert best < 1e-9
    again = smote(df, ["a", "b"], "y", 1, 0.5, 5, 42).toPandas()
    assert again.sort_values("id").reset_index(drop=True).equals(out.sort_values("id").reset_index(drop=True))
    tiny = spark.createDataFrame([r for r in rows if r[3] == 0] + [r for r in rows if r[3] == 1][:5],
                                 "id long, a double, b double, y long")
    with pytest.raises(ValueError):
        smote(tiny, ["a", "b"], "y")
    with pytest.raises(ValueError):
        smote(df, ["a", "b"], "y", 1, 0.1)


def test_knn_one_hot_space_with_tied_projections(spark):
    """Rows that share many coordinates: a 2 x 2 x 300 grid, and 2 blocks in each cell."""
    rows = [(a * 600 + b * 300 + c, float(a), float(b), float(c)) for a in range(2) for b in range(2)
            for c in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    want = _brute([r[0] for r in rows], np.array([r[1:] for r in rows]), 4)
    got = {}
    for r in knn(df, ["a", "b", "c"], 4, max_cell=7).collect():
        got.setdefault(r["id"], []).append((r["nn_rank"], r["nn_id"]))
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == want


def test_knn_far_from_the_origin_and_few_rows(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(200, 3)) + 1e7
    df = spark.createDataFrame([(int(i), *map(float, x)) for i, x in enumerate(X)],
                               "id long, a double, b double, c double")
    want = _brute(list(range(200)), X, 3)
    got = {}
    for r in knn(df, ["a", "b", "c"], 3).collect():
        got.setdefault(r["id"], []).append((r["nn_rank"], r["nn_id"]))
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == want
    few = knn(df.where("id < 3"), ["a", "b", "c"], 5).collect()
    assert len(few) == 6  # every other row is a neighbour
    assert knn(df.where("id < 0"), ["a"], 5).count() == 0


def test_smote_makes_the_rows_due_despite_null_coordinates(spark):
    rows = [(i, None if i % 10 == 0 else float(i % 97), float(i % 31), int(i % 5 == 0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y long")
    out = smote(df, ["a", "b"], "y", 1, 0.5, 5, 42)
    n_min = sum(r[3] for r in rows)
    assert out.where("synthetic = 1").count() == int((2000 - n_min) * 0.5 - n_min)
    assert out.where("synthetic = 1 AND (a IS NULL OR b IS NULL)").count() == 0


def test_input_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def row(i):
        seen.add(1)
        return i, float(i % 17), float(i * 7 % 23), int(i % 5 == 0)

    df = spark.createDataFrame(spark.sparkContext.parallelize(range(200), 4).map(row),
                               "id long, a double, b double, loan_status long")
    from credora.operators import knn
    assert knn.smote(df, ["a", "b"]).where("synthetic = 1").count() == 40
    assert seen.value == 200


def test_blocks_do_not_grow_with_the_rows(spark):
    """Groups that share a block, and boxes that a bound touches, stay as many for 16 times the rows."""
    from credora.operators.knn import LEAF_SAMPLE, _cut_tree, _descend, _sq_dists, _sq_to_boxes

    touched = []
    for n in (2_000, 32_000):
        x = np.random.default_rng(n).normal(size=(n, 3)) * [1, 5, 0]
        x[::7, 1] = 2.0                                  # a value that many rows share
        tree = _cut_tree(x)
        cell = _descend(x, tree)
        sizes = np.bincount(cell)
        assert sizes.min() >= 1 and sizes.max() <= LEAF_SAMPLE and sizes.sum() == n
        low = np.array([x[cell == c].min(axis=0) for c in range(len(sizes))])
        high = np.array([x[cell == c].max(axis=0) for c in range(len(sizes))])
        some = x[:: n // 200]
        d2 = _sq_dists(some, x)
        gap = _sq_to_boxes(some, low, high)
        assert all((gap[:, c] <= d2[:, cell == c].min(axis=1)).all() for c in range(0, len(sizes), 17))
        touched.append((gap <= np.partition(d2, 5, axis=1)[:, 5, None]).sum(axis=1).mean())
    assert touched[1] < 1.5 * touched[0]


def test_knn_skips_rows_with_a_nan_and_finds_all_others(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(300, 2))
    rows = [(int(i), *map(float, x)) for i, x in enumerate(X)] + [(1000 + i, float("nan"), 0.5) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = {}
    for r in knn(df, ["a", "b"], 3, max_cell=50).collect():
        got.setdefault(r["id"], []).append((r["nn_rank"], r["nn_id"]))
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == _brute(list(range(300)), X, 3)
