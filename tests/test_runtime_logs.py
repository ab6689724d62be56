import random
from datetime import datetime, timedelta

import pytest

from latchline.operators import runtime_logs as rl

SCHEMA = "file string, line_no long, line string, func_name string"


def frame(spark, files):
    return spark.createDataFrame([(f, n, x, "clash") for f, lines in files.items() for n, x in enumerate(lines, 1)], SCHEMA)


def calls(df):
    return sorted((r["file"], r["line_no"], r["func_name"], r["call_number"], r["duration_ms"]) for r in df.collect())


def one(spark, parse, *lines):
    return [(c[2], c[4]) for c in calls(parse(frame(spark, {"f": lines})))]


def test_known_answers(spark):
    assert one(spark, rl.parse_json, '{"func":"f","event":"enter","ts":"2024-01-01T00:00:00Z"}', "junk", '{"func":"f","event":"exit","ts":"2024-01-01T00:00:01.5Z"}', '{"func":"g","duration":0.25}', '{"func":"h","elapsed_ms":40}') == [("f", 1500), ("g", 250), ("h", 40)]
    assert one(spark, rl.parse_syslog, "Mar 19 10:32:01 host proc[1]: load_x took 12ms", "Mar 19 10:32:02 host proc[1]: save_y start", "Mar 19 10:32:04 host proc[1]: save_y done") == [("load_x", 12), ("save_y", 2000)]
    assert one(spark, rl.parse_logfmt, "ts=2024-01-01T00:00:00Z func=save duration=1.5s", 'ts=2024-01-01T00:00:00Z func=a func=b msg="call begin"', "ts=2024-01-01T00:00:02Z func=b msg=return") == [("save", 1500), ("b", 2000)]
    assert one(spark, rl.parse_spring, "2024-03-19 10:32:01.456  INFO [main] c.e.MyService - fetchUsers() in 1234ms", "2024-03-19 10:32:01.456  INFO [main] c.e.MyService - Executed SQL (12 ms)") == [("fetchUsers", 1234), ("Executed", 12)]
    assert one(spark, rl.parse_tshark, "dissect_tcp   elapsed=0.342s", "dissect_ip elapsed=2", "0.5\thttp") == [("dissect_tcp", 342), ("dissect_ip", 2000), ("http", 500)]
    assert one(spark, rl.parse_enter_exit, "--> processPayment", "<<< processPayment (1234ms)", "2024-01-01T00:00:00Z [ENTER] fun", "2024-01-01T00:00:03Z [EXIT] fun", "append foo") == [("processPayment", 1234), ("fun", 3000)]
    tagged = "L:INFO D:2025-10-27 10:{} F:com.x.Module(57) FN:{} TI:main C:Cat R:{}"
    assert one(spark, rl.parse_tagged, tagged.format("23:25.312", "name", "completed in 5787 ms"), tagged.format("23:25.000", "other", "x"), tagged.format("23:27.000", "other", "x"), tagged.format("24:28.000", "other", "x"), tagged.format("23:25.312", "run", "took 5 ms")) == [("name", 5787), ("other", 2000)]
    assert one(spark, rl.parse_heuristic, "parse_frame took 12.3ms", "reassemble_stream: 200ms", "completed in 1.2s: process_packet", "the took 5ms", "nothing") == [("parse_frame", 12), ("reassemble_stream", 200), ("process_packet", 1200)]
    rails = ['Started GET "/api/users" for 127.0.0.1 at 2024-03-19 10:32:01 +0000', "Processing by UsersController#index as JSON", "Completed 200 OK in 1234ms (Views: 12.3ms | ActiveRecord: 890ms)"]
    assert sorted(one(spark, rl.parse_rails, *rails)) == [("UsersController#index", 1234), ("UsersController#index:ActiveRecord", 890), ("UsersController#index:Views", 12)]
    custom = lambda d: rl.parse_custom(d, r"(?P<func>\w+) (?P<event>begin|end) at (?P<timestamp>\S+)|(?P<duration>\d+)(?P<unit>ms)")
    assert one(spark, custom, "f begin at 2024-01-01T00:00:00Z", "f end at 2024-01-01T00:00:02Z") == [("f", 2000)]
    assert one(spark, lambda d: rl.parse_custom(d, "("), "parse_frame took 12.3ms") == [("parse_frame", 12)]


def test_nothing_found_is_read_plainly_except_where_it_is_not(spark):
    for name in rl.FALL_BACK:
        assert one(spark, rl.READERS and (lambda d, n=name: rl.parse_as(d, n)), "parse_frame took 12ms") == [("parse_frame", 12)], name
    for name in ("json", "enter_exit"):
        assert one(spark, lambda d, n=name: rl.parse_as(d, n), "parse_frame took 12ms") == [], name


def test_logfmt_keys_are_searched_once_and_only_files_without_calls_are_read_plainly(spark):
    optimised = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    times = "ts=2024-01-01T00:00:00Z", "ts=2024-01-01T00:00:02Z"
    files = {"pairs": [f"{times[0]} event=begin func=b", f"{times[1]} event=finish func=b"], "plain": ["parse_frame took 12ms"], "odd": ['func="" event=begin', "=", 'func=q event=begin duration="2s"', "func=n duration=x5"]}
    lines = frame(spark, files)
    # The keys and the values: two searches, whatever is filtered later.
    assert optimised(rl.logfmt_events(lines)).count("regexp_extract_all") == 2
    plan = optimised(rl.or_plain(rl.paired(rl.logfmt_events(lines)), lines))
    assert rl.PLAIN_DIRECT in plan and rl.PLAIN_DIRECT not in plan.partition("LeftAnti")[2]
    found = rl.parse_logfmt(lines)
    # The pairing reads the stored events: the search is not part of its plan.
    assert "regexp_extract_all" not in optimised(found)
    assert calls(found) == [("odd", 3, "q", 1, 2000), ("odd", 4, "n", 1, 0), ("pairs", 2, "b", 1, 2000), ("plain", 1, "parse_frame", 1, 12)]


def test_detection_and_routing(spark):
    files = {
        "json": ['{"func":"f","elapsed_ms":4}'] * 5, "spring": ["2024-03-19 10:32:01.456  INFO [main] c.e.S - fetchUsers() in 3ms"] * 5, "tshark": ["dissect_tcp   elapsed=0.342s"] * 5,
        "syslog": ["Mar 19 10:32:01 host proc[1]: load_x took 12ms"] * 5, "logfmt": ["ts=2024-01-01T00:00:00Z func=save duration=1.5s"] * 5, "plain": ["reassemble_stream: 200ms"] * 5, "blank": ["", "  "],
    }
    lines = frame(spark, files)
    got = {r["file"]: (r["log_format"], round(r["confidence"], 2)) for r in rl.detect_format(lines).collect()}
    assert {k: v[0] for k, v in got.items()} == {**{k: k for k in files if k not in ("plain", "blank")}, "plain": "heuristic"}
    assert got["plain"][1] == 0.25 and got["json"][1] == 1.0
    found = rl.parse_lines(lines, spark.createDataFrame([("json", "auto"), ("plain", "nobody"), ("syslog", "syslog")], "file string, log_format string"))
    n = {}
    for r in found.collect():
        n[r["file"]] = n.get(r["file"], 0) + 1
    assert n == {k: 5 for k in files if k != "blank"}
    assert rl.parse_lines(lines.limit(0)).count() == 0


@pytest.mark.parametrize("inline_counts", [True, False])
def test_pairing_like_a_state_machine(spark, inline_counts):
    rnd = random.Random(2)
    rows = []
    for f in ("a", "b"):
        t = datetime(2024, 1, 1)
        for n in range(300):
            t += timedelta(milliseconds=rnd.randrange(1, 4000))
            rows.append((f, n, 0, "l", rnd.choice("xyz"), rnd.choice(["enter", "exit", "inline"]), int(t.timestamp() * 1e6), None))
    rows = [(*r[:7], 5 if r[5] == "inline" else None, r[5] == "inline" and not inline_counts) for r in rows]
    df = spark.createDataFrame(rows, "file string, line_no long, part int, line string, func_name string, kind string, ts long, ms long, alone boolean")
    want, pending = [], {}
    for f, n, _, _, fn, kind, ts, ms, alone in rows:
        if kind == "inline":
            start = pending.pop((f, fn), ts) if not alone else ts
            want.append((f, n, fn, ms, start))
        elif kind == "enter":
            pending[f, fn] = ts
        elif (f, fn) in pending:
            st = pending.pop((f, fn))
            want.append((f, n, fn, (ts - st) // 1000, st))
    got = [(r["file"], r["line_no"], r["func_name"], r["duration_ms"], r["timestamp_us"]) for r in rl.paired(df).collect()]
    assert sorted(got) == sorted(want)


def test_excerpt_is_clipped(spark):
    lines = frame(spark, {"f": ["a", "b ", "c", "d"]})
    got = rl.with_excerpt(lines.filter("line_no in (1, 3)").select("file", "line_no"), lines, 1, 1)
    assert {r["line_no"]: r["log_excerpt"] for r in got.collect()} == {1: "a\nb", 3: "b\nc\nd"}


def test_null_lines(spark):
    rows = [("f", 1, None, "x"), (None, 2, "parse_frame took 12ms", "x"), ("f", None, "parse_frame took 12ms", "x"), ("f", 3, "x" * 100_000, "x"), ("f", 4, "parse_frame took 12ms", "x")]
    assert calls(rl.parse_heuristic(spark.createDataFrame(rows, SCHEMA))) == [("f", 4, "parse_frame", 1, 12)]
