import numpy as np
import pytest

from latchline.llm.quantiles import RelativeSketch, merged, percentiles, rank_error, sketch_values

QS = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}


def off(values, q, got):
    s, rank = np.sort(values), np.ceil(q * len(values))
    return max(0, np.searchsorted(s, got, "left") + 1 - rank, rank - np.searchsorted(s, got, "right"))


@pytest.mark.parametrize("kind", ["lognormal", "ties", "rising", "falling"])
def test_error_bound_after_merging(kind):
    rng = np.random.default_rng(3)
    n = 120_000
    v = {"lognormal": rng.lognormal(8, 2, n), "ties": rng.integers(0, 20, n).astype(float), "rising": np.arange(n, dtype=float), "falling": np.arange(n, 0, -1.0)}[kind]
    parts = []
    for x in np.array_split(v, 24):
        s = RelativeSketch()
        s.add(x)
        parts.append(RelativeSketch.load(s.dump()))
    whole = parts[0]
    for p in parts[1:]:
        whole.merge(p)
    assert whole.n == n and whole.low == v.min() and whole.high == v.max()
    assert sum(len(lv.items) for lv in whole.levels) < 12_000
    for q, got in zip(QS.values(), whole.quantiles(list(QS.values())), strict=True):
        assert off(v, q, got) <= rank_error() * (1 - q) * n + 1


def test_errors_of_parts_cancel():
    """Parts with equal ranks toss different coins: the error of 400 merged parts is far below the bound of one."""
    rng = np.random.default_rng(17)
    v = rng.permutation(400 * 2000).astype(float)
    whole = RelativeSketch(seed=1)
    for i, x in enumerate(np.split(v, 400)):
        s = RelativeSketch(seed=i)
        s.add(x)
        whole.merge(s)
    for q, got in zip(QS.values(), whole.quantiles(list(QS.values())), strict=True):
        assert off(v, q, got) <= 0.01 * (1 - q) * len(v) + 1
    assert len({RelativeSketch(seed=i).seed for i in range(9)}) == 9


def test_small_sets_are_exact_and_weights_hold():
    s = RelativeSketch()
    s.add(np.array([5.0, np.nan, 1.0, 3.0]))
    assert (s.n, s.quantiles([0.0, 0.5, 1.0])) == (3, [1.0, 3.0, 5.0])
    assert np.isnan(RelativeSketch().quantiles([0.5])[0])
    s.add(np.random.default_rng(1).random(50_000))
    assert sum(len(lv.items) << h for h, lv in enumerate(s.levels)) == s.n


def test_days_join_into_all(spark):
    rng = np.random.default_rng(9)
    rows = [(f"s{i % 3}" if i % 10 else None, i % 4, float(x) if i % 50 else None, "x") for i, x in enumerate(rng.lognormal(5, 1, 6000))]
    df = spark.createDataFrame(rows, "step string, day int, v double, n string").repartition(5)
    days = merged(sketch_values(df, ["step", "day"], "v"), ["step", "day"])
    assert days.count() == 14  # step null falls on even days only
    got = {r["step"]: r for r in percentiles(merged(days, ["step"]), ["step"], QS).collect()}
    for step in ("s0", "s1", "s2", None):
        v = np.array([r[2] for r in rows if r[0] == step and r[2] is not None])
        assert got[step]["n"] == len(v)
        for name, q in QS.items():
            assert off(v, q, got[step][name]) <= rank_error() * (1 - q) * len(v) + 1
    assert percentiles(merged(sketch_values(df.limit(0), ["step"], "v"), ["step"]), ["step"], QS).count() == 0
