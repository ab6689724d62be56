import random
from datetime import datetime, timedelta

from latchline.llm import topn
from latchline.llm.runs import event_runs, known_functions
from latchline.llm.topn import top_per_group

T0 = datetime(2024, 1, 1)


def brute_runs(rows):
    out = []
    for s in {r[0] for r in rows if r[0] is not None}:
        seen, run = {}, []
        for r in sorted((r for r in rows if r[0] == s and r[1] is not None), key=lambda r: (r[1], r[2])):
            seen.setdefault(r[1], r)
        for r in [*seen.values(), None]:
            if run and r and r[3] is not None and r[3] == run[-1][3] and r[4] and run[-1][4] and abs(r[4] - run[-1][4]) <= timedelta(seconds=60):
                run.append(r)
                continue
            if run:
                span = None if run[0][4] is None or run[-1][4] is None else (run[-1][4] - run[0][4]) // timedelta(milliseconds=1)
                out.append((s, run[0][1], run[-1][1], len(run), span))
            run = [r]
    return sorted(out, key=str)


def test_runs_like_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for s in (1, 2, 3):
        t = T0
        for n in range(1, 80):
            t += timedelta(milliseconds=rnd.choice([5, 900, 60_000, 61_000]))
            row = (s, n * 3, rnd.randrange(10**6), rnd.choice([7, 7, 7, 8, None]), rnd.choice([t, t, t, t, None]), "clash")
            rows += [row] * rnd.choice([1, 1, 1, 2])
    rows += [(None, 1, 1, 7, T0, "x"), (4, None, 1, 7, T0, "x"), (5, 1, 1, 7, T0, "x")]
    df = spark.createDataFrame(rows, "s long, p long, i long, f long, t timestamp_ntz, run_length string")
    for chunk in (1 << 17, 10):
        got = event_runs(df, "s", "p", "i", "f", "t", chunk=chunk)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_runs(rows)
    assert event_runs(df.limit(0), "s", "p", "i", "f", "t").count() == 0


def test_names_mean_the_apps_function(spark):
    names = ["load_v1", "LOAD_V1#3", " load_v1 (retry 2)", "load_v1[9]", "load_v1@ab12", "load_v1:77", "load_v1-attempt-1", "load_v1()", "load_v2", "other", None, ""]
    rec = spark.createDataFrame([(1, n) for n in names] + [(2, "load_v1"), (None, "load_v1")], "session_id long, n string")
    ses = spark.createDataFrame([(1, "a"), (2, "b")], "id long, app_name string")
    idx = spark.createDataFrame([(10, "a", "Load_v1"), (11, "a", "load_v2"), (12, "c", "load_v1")], "id long, app_name string, function_name string")
    got = [(r["session_id"], r["n"], r["f"]) for r in known_functions(rec, ses, idx, "session_id", "n", "f").collect()]
    assert sorted(got, key=str) == sorted([(1, n, 10) for n in names[:8]] + [(1, "load_v2", 11), (1, "other", None), (1, None, None), (1, "", None), (2, "load_v1", None), (None, "load_v1", None)], key=str)


def test_top_ties_nulls_deliveries(spark):
    rows = [(i, i % 3 if i % 7 else None, (i * 7) % 5, i % 11, "x") for i in range(1, 200)] + [(500, 1, None, 1, "x"), (None, 1, 99, 1, "x")]
    rows += [(i + 1000, g, d, c, x) for i, g, d, c, x in rows if i and i % 4 == 0]
    df = spark.createDataFrame(rows, "id long, g long, score long, item long, rank_no string")
    once = {}
    for i, g, d, c, _ in sorted((r for r in rows if r[0] is not None and r[2] is not None)):
        once.setdefault((g, d, c), (g, d, i))
    want = []
    for g in {x[0] for x in once.values()}:
        best = sorted((x for x in once.values() if x[0] == g), key=lambda x: (-x[1], x[2]))[:3]
        want += [(g, n + 1, x[2]) for n, x in enumerate(best)]
    got = top_per_group(df, ["g"], "score", "id", 3, "item")
    assert got.columns == ["g", "rank_no", "item_id"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert top_per_group(df.limit(0), ["g"], "score", "id", 3).count() == 0
    assert sorted(map(tuple, top_per_group(df.dropDuplicates(["id"]), ["g"], "score", "id", 1).filter("g = 2").collect())) == [(2, 1, min(r[0] for r in rows if r[0] and r[1] == 2 and r[2] == 4))]


def test_group_limit_before_the_only_shuffle(spark):
    rows = spark.range(1000).selectExpr("id % 3 g0", "id % 7 score", "id item_id")
    plan = topn._ranked(rows, "g0", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_groups_of_many_repeats_and_equal_scores(spark):
    """More repeats than the spare rows hold, and a group of one score: both exact."""
    rows = [(i, "repeats", 9, 1) for i in range(50)] + [(50 + i, "repeats", 8 - i, 2 + i) for i in range(5)]
    rows += [(1000 + i, "equal", 5, i % 400) for i in range(800)] + [(5000, None, 1, None), (5001, None, 1, None), (5002, "short", 2, 1), (5003, "short", 2, 1)]
    df = spark.createDataFrame(rows, "id long, g string, score long, item long").repartition(4)
    got = {(r["g"], r["rank_no"]): r["item_id"] for r in top_per_group(df, ["g"], "score", "id", 3, "item").collect()}
    assert got == {("repeats", 1): 0, ("repeats", 2): 50, ("repeats", 3): 51, ("equal", 1): 1000, ("equal", 2): 1001, ("equal", 3): 1002, (None, 1): 5000, (None, 2): 5001, ("short", 1): 5002}
