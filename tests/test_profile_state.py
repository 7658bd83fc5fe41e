"""Wide quantiles against NumPy; stored profile states against the whole table."""

import numpy as np
import pytest

from credora.operators import profile
from credora.operators.quantile import wide_quantiles

PROBS = [0.0, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(8)
    n = 4000
    cols = {"a": rng.normal(size=n) * 3 + 1e5, "b": np.floor(rng.exponential(3, n)), "c": np.where(rng.random(n) < 0.4, 7.0, rng.random(n)),
            "d": np.full(n, np.nan), "e": rng.random(n)}
    cols["e"][rng.random(n) < 0.5] = np.nan
    return cols, rng.integers(0, 5, n)


@pytest.fixture(scope="module")
def df(spark, table):
    cols, day = table
    rows = [(int(day[i]) if day[i] else None, *[None if np.isnan(v[i]) else float(v[i]) for v in cols.values()])
            for i in range(len(day))]
    return spark.createDataFrame(rows, "day int, a double, b double, c double, d double, e double").repartition(4).cache()


@pytest.mark.parametrize("select_rows", [10 ** 6, 40])
def test_wide_quantiles_equal_numpy(df, table, select_rows):
    got = wide_quantiles(df, list("abcde"), PROBS, select_rows)
    for c in "abce":
        v = table[0][c][~np.isnan(table[0][c])]
        assert [got[c, p] for p in PROBS] == pytest.approx(np.quantile(v, PROBS).tolist())
    assert not any(c == "d" for c, _ in got)


def test_wide_quantiles_in_several_aggregates(df, monkeypatch):
    from credora.operators import quantile

    one = wide_quantiles(df, list("abce"), [0.5])
    monkeypatch.setattr(quantile, "COLUMNS_AT_ONCE", 1)
    assert wide_quantiles(df, list("abce"), [0.5]) == one


def test_describe_keeps_empty_columns(df):
    got = {r["feature"]: r for r in profile.describe(df, list("abcde")).collect()}
    assert len(got) == 5 and got["d"]["count"] == 0 and got["d"]["q50"] is None
    assert profile.describe(df.limit(0), ["a", "b"]).count() == 2


def test_states_merge_to_the_whole(df, table):
    """Moments are those of the whole; quartiles are off by at most 1 percent of the ranks."""
    cols = list("abcde")
    states = profile.profile_state(df, cols, ["day"]).checkpoint()
    assert states.count() == 25
    exact = {r["feature"]: r for r in profile.describe(df, cols).collect()}
    for found in (profile.describe_states(states), profile.describe_states(profile.profile_state(df, cols)),
                  profile.describe_states(profile.merge_states(states, ["day"]))):
        for r in found.collect():
            want = exact[r["feature"]]
            assert r["count"] == want["count"]
            if not r["count"]:
                assert r["q50"] is None and r["mean"] is None
                continue
            for c in ("mean", "std", "min", "max"):
                assert r[c] == pytest.approx(want[c], rel=1e-9)
            v = np.sort(table[0][r["feature"]][~np.isnan(table[0][r["feature"]])])
            for p, c in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
                low, high = np.searchsorted(v, r[c], "left") / len(v), np.searchsorted(v, r[c], "right") / len(v)
                assert low - 0.01 <= p <= high + 0.01


def test_states_by_group(df):
    states = profile.profile_state(df, ["a", "b"], ["day"])
    by_day = profile.describe_states(states, ["day"])
    assert by_day.count() == 10
    one = profile.describe(df.where("day = 1"), ["b"]).first()
    got = by_day.where("day = 1 AND feature = 'b'").first()
    assert (got["count"], got["max"]) == (one["count"], one["max"]) and got["mean"] == pytest.approx(one["mean"])


def test_sketches_of_many_parts_merge_few(spark, df, monkeypatch):
    parts, kind = [], type(df)
    agg = kind.agg
    monkeypatch.setattr(kind, "agg", lambda d, *a: parts.append(d.rdd.getNumPartitions()) or agg(d, *a))
    many = wide_quantiles(df.repartition(50), list("abce"), [0.5])
    assert parts and parts[0] <= 16
    assert many == wide_quantiles(df, list("abce"), [0.5])
