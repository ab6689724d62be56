from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from latchline.operators.intervals import periods_and_gaps

T0 = datetime(2024, 1, 1)
SCHEMA = "run long, a timestamp_ntz, b timestamp_ntz, span_kind string"


def brute(rows):
    out = []
    for run in {r for r, a, b in rows if r is not None and a is not None and b is not None and b > a}:
        merged = []
        for a, b in sorted((a, b) for r, a, b in rows if r == run and a is not None and b is not None and b > a):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(run, "period", a, b) for a, b in merged]
        out += [(run, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:], strict=False)]
    return sorted(out)


def us(t):
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = periods_and_gaps(df, "run", "a", "b", **kw)
    assert got.columns == ["run", "span_kind", "from_us", "to_us"]
    return sorted(tuple(r) for r in got.collect())


def check(spark, rows, **kw):
    assert run(spark, rows, **kw) == sorted((r, k, us(a), us(b)) for r, k, a, b in brute(rows))


def test_overlap_nest_touch_gap_null(spark):
    t = lambda m: T0 + timedelta(minutes=m)
    rows = [(1, t(0), t(10)), (1, t(5), t(7)), (1, t(10), t(12)), (1, t(20), t(30)), (1, t(20), t(30)), (1, t(40), t(35)), (1, None, t(5)), (1, t(50), None), (None, t(0), t(1)), (2, t(3), t(3)), (3, t(0), t(90))]
    check(spark, rows)
    check(spark, rows, bucket_us=60_000_000, rank_chunk=1)


def test_empty(spark):
    assert run(spark, []) == []


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 60), st.integers(0, 60)), max_size=40))
def test_like_brute_force(spark, rows):
    check(spark, [(r, T0 + timedelta(minutes=a), T0 + timedelta(minutes=b)) for r, a, b in rows], bucket_us=600_000_000, rank_chunk=3)
