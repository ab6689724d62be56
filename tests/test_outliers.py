from datetime import datetime, timedelta

import numpy as np

from latchline.functions.statespace import describe, fault_kinds, first_spread, near_counts, spread_counts, vanished
from latchline.operators.outliers import first_deliveries, implausible_readings

T0 = datetime(2024, 1, 1)


def noisy(n, level=10_000.0, spread=0.1, seed=1):
    return np.round(level * np.exp(np.random.default_rng(seed).normal(0, spread, n)))


def test_spread_is_blind_to_second_levels_and_drift():
    y = np.log(noisy(400)) + np.linspace(0, 1, 400) + (np.arange(400) % 3 == 0) * 1.5
    own = np.ones(len(y), bool)
    first = first_spread(near_counts(y, own))
    assert 0.07 < describe(first, spread_counts(y, own, first)).spread < 0.14


def test_spikes_both_ways_and_impossible():
    v = noisy(200)
    v[[50, 120]] = [100_000, 900]
    v[[10, 77]] = [-5, 90_000_000]
    kinds = fault_kinds(v)
    assert {i: k for i, k in enumerate(kinds) if k} == {50: "spike", 120: "spike", 10: "impossible", 77: "impossible"}


def test_usual_changes_are_not_flagged():
    shift = np.concatenate([noisy(100), noisy(100, 40_000, seed=2)])
    rhythm = noisy(200) * np.where(np.arange(200) % 7 == 0, 4, 1)
    drift = noisy(300) * np.exp(np.linspace(0, 2, 300))
    for v in (shift, rhythm, drift, noisy(200)):
        assert not any(fault_kinds(v))


def test_stuck_needs_variation_elsewhere():
    v = noisy(100)
    v[30:37] = v[30]
    assert [i for i, k in enumerate(fault_kinds(v)) if k == "stuck"] == list(range(30, 37))
    assert not any(fault_kinds(np.full(50, 1000.0)))
    assert not any(fault_kinds(np.array([])))


def test_stuck_in_small_and_in_mostly_stuck_sources():
    assert [k for k in fault_kinds(np.array([5.0] * 6 + [7, 9, 4, 8, 6]))] == ["stuck"] * 6 + [""] * 5
    v = np.concatenate([noisy(400), np.full(900, 10_100.0), noisy(200, seed=3)])
    assert (fault_kinds(v) == "stuck").sum() == 900
    usual = np.concatenate([np.full(40, 1000.0), [1003, 1001], np.full(50, 1000.0), [900, 1100, 1002, 1007, 998], np.full(30, 1000.0)])
    assert not (fault_kinds(usual) == "stuck").any()
    want = np.zeros(20, bool)
    want[5:12] = True
    assert (vanished(np.array([1.0, 2, 3, 4, 5, *[6] * 7, 7, 7, 7, 7, 7, 8, 8, 9])) == want).all()


def test_spread_of_irregular_second_level():
    rng = np.random.default_rng(5)
    v = np.round(np.where(rng.random(80) < 0.45, 5500, 2200) * np.exp(rng.normal(0, 0.08, 80)))
    v[40] = 60_000
    assert {i: k for i, k in enumerate(fault_kinds(v)) if k} == {40: "spike"}


def test_blocks_of_any_size_give_the_same(spark):
    rng = np.random.default_rng(11)
    n = 6000
    v = np.round(np.exp(9 + rng.normal(0, 0.1, n) + (np.arange(n) % 7 == 0) * 1.2 + (np.arange(n) > 2500) * 0.8 + np.arange(n) / n))
    v[rng.choice(n, 60, replace=False)] *= 20
    v[rng.choice(n, 40, replace=False)] = -1
    for a, length in ((60, 7), (125, 30), (900, 1400), (4000, 6), (5990, 10)):
        v[a : a + length] = v[a]
    rows = [(i, 1, float(x), T0 + timedelta(minutes=i)) for i, x in enumerate(v)] + [(n + i, 2, float(x), T0 + timedelta(days=i)) for i, x in enumerate(noisy(150))]
    df = spark.createDataFrame(rows, "id long, s long, v double, at timestamp_ntz")
    got = [{tuple(r) for r in implausible_readings(df, "id", ["s"], "v", "at", block=b).collect()} for b in (64, 1000, 8192, 1 << 40)]
    assert got[0] == got[1] == got[2] == got[3]
    kinds = [k for _, k in got[3]]
    assert kinds.count("impossible") > 30 and kinds.count("stuck") > 1400 and 30 < kinds.count("spike") <= 60


def test_operator_blocks_nulls_ties(spark):
    v = noisy(300)
    v[[40, 160, 299]] = [200_000, 300, 400_000]
    rows = [(i, 1, "s", float(x), T0 + timedelta(hours=i // 2), "x") for i, x in enumerate(v)]
    rows += [(1000, 1, "s", None, T0, "x"), (1001, None, "s", 1e12, T0, "x"), (1002, 1, None, -1.0, T0, "x"), (1003, 1, "s", -1.0, None, "x"), (1004, 2, "s", -1.0, T0, "x")]
    df = spark.createDataFrame(rows, "id long, repo long, step string, v double, at timestamp_ntz, flag_kind string")
    want = {40: "spike", 160: "spike", 299: "spike", 1004: "impossible"}
    for kw in ({}, {"block": 64}):
        got = implausible_readings(df, "id", ["repo", "step"], "v", "at", **kw)
        assert {r["id"]: r["flag_kind"] for r in got.collect()} == want
    assert implausible_readings(df.limit(0), "id", ["repo", "step"], "v", "at").count() == 0


def test_first_deliveries(spark):
    df = spark.createDataFrame([(3, "a", None, "x"), (1, "a", None, "x"), (2, "a", 1, "y"), (5, None, None, "x")], "id long, k string, n int, t string")
    assert sorted(r["id"] for r in first_deliveries(df, "id", ["k", "n"], ["t"]).collect()) == [1, 2, 5]
