import json
import zipfile
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from latchline.functions.sourcecode import frameworks, read_source
from latchline.functions.units import bare_name, duration_ms, name_tokens
from latchline.operators import codeindex, flows, ingest, linkage, text_rules, timings
from latchline.operators.ci_logs import archive_steps, flat_steps, header_step
from latchline.sources import files

Z = "2024-03-01T10:00:{:06.3f}0000Z {}"


def ci(spark, *lines):
    return spark.createDataFrame([("f", n, x) for n, x in enumerate(lines, 1)], "file string, line_no long, line string")


def test_archive_steps(spark):
    rows = archive_steps(ci(spark, "=== build/1_Set up job.txt ===", Z.format(0, "a"), Z.format(1.5, "b"), "=== build/system.txt ===", Z.format(2, "x"), "=== build/2_Run tests.txt ===", Z.format(3, "##[error]boom"), Z.format(8.1, "c"), "=== 3_empty.txt ===", "=== whole (job).txt ===", Z.format(9, "##[warning]w"), Z.format(12, "d"))).collect()
    got = [(r["step_name"], r["step_number"], r["duration_ms"], r["status"], r["annotation"]) for r in sorted(rows, key=lambda r: r["section_no"])]
    assert got == [("Set up job", 1, 1500, "success", None), ("Run tests", 2, 5100, "failure", "error"), ("whole (job)", 3, 3000, "success", "warning")]


def test_flat_steps_like_a_state_machine(spark):
    rng = np.random.default_rng(1)
    for _ in range(3):
        kinds = [str(x) for x in rng.choice(["group", "endgroup", "", "error"], 60)]
        lines = [Z.format(i / 2, f"##[{k}]n{i}" if k else f"n{i}") for i, k in enumerate(kinds)]
        steps, cur = [], None
        for i, k in enumerate(kinds):
            if k == "group":
                if cur:
                    steps.append(cur)
                cur = [f"n{i}", len(steps) + 1, i, i, "success"]
                continue
            if k == "endgroup" and cur:
                cur[3] = i
                steps.append(cur)
                cur = None
                continue
            if k == "error" and cur:
                cur[4] = "failure"
            if cur is None:
                cur = ["Setup", 0, i, i, "success"]
            cur[3] = i
        if cur:
            steps.append(cur)
        want = [(n, no, (b - a) * 500, s) for n, no, a, b, s in steps]
        got = [(r["step_name"], r["step_number"], r["duration_ms"], r["status"]) for r in flat_steps(ci(spark, *lines)).orderBy("section_no").collect()]
        assert got == want


def test_headers_and_excerpts(spark):
    df = spark.createDataFrame([("build/2_Run npm install.txt",), ("test (3.13).txt",), ("b/system.txt",), ("10_test (a).txt",)], "h string")
    name, number = header_step(F.col("h"))
    assert [tuple(r) for r in df.select(name, number).collect()] == [("Run npm install", 2), ("test (3.13)", 0), (None, 0), ("test (a)", 10)]


def test_step_excerpts_keep_both_ends(spark):
    short = ["##[group]short", "one", "", "two", "##[endgroup]"]
    long = ["##[group]long", *[f"line {n} " + "y" * (n % 90 + 1) for n in range(200)], "z" * 5000, "last"]
    lines = [Z.format(n / 1000, x) for n, x in enumerate([*short, *long])]
    got = {r["step_name"]: r["log_excerpt"] for r in flat_steps(ci(spark, *lines)).collect()}
    text = "\n".join(long)
    assert got["long"] == text[:1000] + "\n... [truncated] ...\n" + text[-1000:]
    assert got["short"].startswith("##[group]short\none") and got["short"].endswith("two\n##[endgroup]")


def history(spark):
    t0 = datetime(2024, 3, 1, 10)
    runs = [(i, 1, t0 + timedelta(hours=i)) for i in range(10)]
    data = {"Install": [3000, 3200, 3400, 3600, 3800, 4000, 4200, 4400, 4600, 5000], "Test": [2000, 2000, 2100, 2000, 1900, 2000, 2100, 2000, 2000, 2000], "Deploy": [500] * 10}
    steps = [(k * 100 + i, i, n, v[i]) for k, (n, v) in enumerate(data.items()) for i in range(10)]
    steps += [(999, 3, None, 1), (998, 3, "Untimed", None)]
    return spark.createDataFrame(runs, "id long, repository_id long, created_at timestamp_ntz"), spark.createDataFrame(steps, "id long, pipeline_run_id long, step_name string, duration_ms long")


def test_ranking_known_answers(spark):
    runs, steps = history(spark)
    s = {r["step_name"]: r for r in timings.step_statistics(runs, steps).collect()}
    assert s["Install"]["p95_ms"] == 5000 and s["Deploy"]["std_ms"] == 0 and s["Install"]["latest_ms"] == 5000 and set(s) == {"Install", "Test", "Deploy"}
    r = timings.bottleneck_ranking(runs, steps).orderBy("rank_no").collect()
    assert [x["step_name"] for x in r][0] == "Install" and r[0]["trend"] == "increasing" and {x["trend"] for x in r[1:]} == {"stable"}
    assert abs(sum(x["pct_of_total"] for x in r) - 100) < 0.2
    assert timings.bottleneck_ranking(runs, steps, last_n=2).filter("n > 2").count() == 0
    assert timings.bottleneck_ranking(runs.limit(0), steps).count() == 0


def test_regressions_like_brute_force(spark):
    rng = np.random.default_rng(4)
    calls = [(i, int(rng.integers(1, 9)), f"f{rng.integers(0, 3)}", int(rng.choice([10, 60, 70, 100, 120, 400]))) for i in range(300)]
    app = {s: f"a{s % 2}" for s in range(1, 9)}
    want = {}
    for i, s, f, d in calls:
        others = sorted(x[3] for x in calls if app[x[1]] == app[s] and x[2] == f and x[1] != s)
        if len(others) >= 3 and d >= 50 and others[len(others) // 2] > 0 and d / others[len(others) // 2] >= 1.5:
            want.setdefault((s, f), (i, d, float(others[len(others) // 2])))
    df = spark.createDataFrame([*calls, (900, None, "f0", 500), (901, 1, None, 500), (902, 1, "f0", None)], "id long, session_id long, function_name string, duration_ms long")
    got = timings.regressions(df, spark.createDataFrame(list(app.items()), "id long, app_name string")).collect()
    assert {(r["session_id"], r["function_name"]): (r["call_id"], r["current_ms"], r["baseline_ms"]) for r in got} == want


def test_line_model(spark):
    rows = [(i, float(i), 3.0 * i + 2 + (500 if i == 40 else (i % 3))) for i in range(100)] + [(200, None, 1.0), (201, 5.0, None)]
    got = timings.line_model(spark.createDataFrame(rows, "id long, x double, y double"), "x", "y")
    assert [r["id"] for r in got.filter("is_anomaly").collect()] == [40] and got.count() == 100


def test_names(spark):
    df = spark.createDataFrame([("mod.Class.__run(x)",), ("ns::Do_It()",), ("dissect_nas_attach_request",)], "n string")
    assert [r[0] for r in df.select(bare_name(F.col("n"))).collect()] == ["__run", "do_it", "dissect_nas_attach_request"]
    assert set(df.select(name_tokens(F.col("n"))).collect()[2][0]) == {"nas", "attach", "request", "req"}
    ms = spark.createDataFrame([("1.5", "s"), ("0.4", "us"), ("x", "ms"), ("7", "msec."), ("3", "min")], "v string, u string").select(duration_ms(F.col("v"), F.col("u")))
    assert [r[0] for r in ms.collect()] == [1500, 1, 0, 7, 180000]


def test_linkage_stages(spark):
    idx = spark.createDataFrame([(1, "a", "loadUsers", "src/users.py", 3), (2, "a", "dissect_attach_req", "packet-attach.c", 9), (3, "a", "render_page", "src/page.py", 5), (4, "b", "loadUsers", "x.py", 1)], "id long, app_name string, function_name string, file_path string, line_number int")
    names = spark.createDataFrame([("a", "loadUsers"), ("a", "svc.LOADUSERS()"), ("a", "render_pages"), ("a", "attach_request"), ("a", "unrelated"), ("a", None), (None, "loadUsers")], "app_name string, name string")
    got = {r["name"]: (r["function_id"], r["match_method"]) for r in linkage.match_names(names.filter("app_name = 'a'"), idx).collect()}
    assert got == {"loadUsers": (1, "exact"), "svc.LOADUSERS()": (1, "normalised"), "render_pages": (3, "fuzzy"), "attach_request": (2, "tokens"), "unrelated": (None, None), None: (None, None)}
    assert linkage.match_names(names, idx).filter("app_name is null").first()["function_id"] is None
    texts = spark.createDataFrame([(1, 1, "Deploying to staging"), (1, 2, "done"), (2, 1, "Deploying to stagin"), (3, 1, "nothing alike")], "text_id long, line_no long, line string")
    strings = spark.createDataFrame([(7, "Deploying to staging"), (8, None)], "string_id long, log_string string")
    assert {r["text_id"]: (r["string_id"], r["confidence"] == 1.0) for r in linkage.text_matches(texts, strings).collect()} == {1: (7, True), 2: (7, False)}


def test_graph(spark):
    rows = [(n, "a", n, json.dumps(c) if c is not None else None) for n, c in {"a": ["b"], "b": ["c", "gone"], "c": ["a", "d"], "d": None, "e": ["d"], "bad": None}.items()]
    idx = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)] + [(99, "a", "x", "not json")], "id long, app_name string, function_name string, calls_json string")
    got = {(r["function_name"], r["caller"]): r["min_depth"] for r in linkage.caller_closure(idx).collect()}
    assert got[("d", "c")] == 1 and got[("d", "b")] == 2 and got[("d", "a")] == 3 and got[("d", "e")] == 1 and ("a", "a") not in got
    assert linkage.direct_callers(idx).filter("callee = 'd'").first()["callers"] == "c,e"


def test_flows(spark):
    ok = ["x", flows.BEGIN + " traceId: abc1 T : 2024-01-01T23:59:500000000", "noise", *flows.SEQUENCE, flows.COUNTS + " T : 2024-01-01T00:00:100000000", "end"]
    bad = [flows.BEGIN, flows.PROGRESS, "[console-function || closeTrace]", *flows.SEQUENCE[1:]]
    every = ok + bad + ok
    bounds = lambda xs: flows.flow_bounds(list(range(len(xs))), xs)
    assert bounds(every) == [(1, 11), (len(ok) + len(bad) + 1, len(ok) + len(bad) + 11)]
    assert bounds([]) == [] and bounds(bad) == []
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(ok)] + [("g", 1, None), (None, 1, flows.BEGIN)], "file string, line_no long, line string")
    (r,) = flows.flow_durations(df).collect()
    assert (r["flow_id"], r["trace_id"], r["seconds"]) == (1, "abc1", 20.0)


def test_source_rules(spark, tmp_path):
    django = "from django.db import models\ndef view(request):\n    for user in User.objects.filter(a=1):\n        Order.objects.filter(user=user).first()\n        Order.objects.filter(user=user).count()\n    for x in User.objects.all():\n        if x.ok:\n            pass\n"
    sql = "import sqlite3\ndef bad(request, cursor, con):\n    uid = 1\n    sql = f'SELECT * FROM users WHERE id = {uid}'\n    cursor.execute(sql)\n    cursor.execute('SELECT 1')\n    cursor.execute('DELETE FROM t WHERE id=' + uid)\n    con.commit()\n    for i in range(3):\n        con.commit()\n    try:\n        con.commit()\n    except Exception:\n        con.rollback()\n"
    kinds = lambda t: sorted((f["category"], f["line_number"]) for f in read_source(t, "python").findings)
    # Line 7 reads a row's attribute in a loop over a query that joins nothing.
    assert kinds(django) == [("n_plus_one", 4), ("n_plus_one", 5), ("n_plus_one", 7), ("orm_all_no_filter", 6), ("orm_count_in_loop", 5), ("orm_missing_select_related", 7)]
    assert kinds(sql) == [("raw_sql_injection", 5), ("raw_sql_injection", 7), ("transaction_commit_in_loop", 10), ("transaction_no_rollback", 8)]
    assert frameworks(django) == ["django"] and frameworks(sql) == ["raw_sql"]
    assert frameworks("import { PrismaClient } from '@prisma/client'\npg.query('x')", "typescript") == ["prisma", "raw_sql"] and frameworks("x", "go") == []
    assert read_source("def f(:\n", "python").functions == [] and read_source(None, "python").functions == []
    js = read_source("const go = async (x) => {\n  load(x);\n}\nfunction load(y) {\n  return y;\n}\n", "javascript").functions
    assert [(f["function_name"], f["calls"]) for f in js] == [("go", ["load"]), ("load", [])]
    (tmp_path / "a.py").write_text("class A:\n    def m(self):\n        log.info('hello')\n        return helper(1)\n\ndef helper(x):\n    return x\n")
    (tmp_path / "b.go").write_text("func Run(x int) {\n  helper(x)\n}\n")
    (tmp_path / "c.txt").write_text("no")
    src = files.source_files(spark, str(tmp_path))
    got = {(r["qualified_name"], tuple(r["calls"])) for r in codeindex.functions(src).collect()}
    assert got == {("A.m", ("info", "helper")), ("helper", ()), ("Run", ("helper",))}
    assert [r["log_string"] for r in codeindex.log_calls(src).collect()] == ["hello"]
    assert codeindex.findings(src).count() == 0


def test_text_rules(spark):
    df = spark.createDataFrame([("a/b.tsx",), ("src/auth/login.py",), ("x/db/q.py",), ("Dockerfile",), ("web/ui/x.py",), ("core/x.py",), ("x\\views\\y.sql",)], "p string")
    assert [r[0] for r in df.select(text_rules.classify_domain(F.col("p"))).collect()] == ["frontend", "security", "database", "infrastructure", "frontend", "backend", "database"]
    t = spark.createDataFrame([("x = eval (y)\npassword = 'p'",), (None,), ("fine",), ('say ```json\n{"a": 1}\n``` ok',)], "t string")
    assert [r[0] for r in t.select(text_rules.security_signals(F.col("t"))).collect()] == [["possible eval injection", "possible hard-coded password"], [], [], []]
    assert t.select(text_rules.json_in_text(F.col("t"))).collect()[3][0] == '{"a": 1}'
    d = spark.createDataFrame([("a\nb", "a\nc")], "x string, y string").select(text_rules.unified_diff("x", "y")).first()[0]
    assert "-b" in d and "+c" in d


def test_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "logs.zip", "w") as z:
        z.writestr("2_b.txt", "x\ny")
        z.writestr("1_a.txt", "q")
        z.writestr("skip.bin", "no")
    got = [(r["entry"], r["line_no"], r["line"]) for r in files.zip_lines(spark, str(tmp_path)).orderBy("entry", "line_no").collect()]
    assert got == [("1_a.txt", 1, "q"), ("2_b.txt", 1, "x"), ("2_b.txt", 2, "y")]
    assert files.zip_lines(spark, str(tmp_path), most_bytes=1).count() == 0
    d = tmp_path / "t"
    d.mkdir()
    (d / "a.log").write_text("one\ntwo\n")
    assert [(r["line_no"], r["line"]) for r in files.text_lines(spark, str(d)).orderBy("line_no").collect()] == [(1, "one"), (2, "two")]
    (d / "p.tsv").write_text("frame.number\tframe.time_delta\tframe.protocols\n1\t0.5\teth:ip:tcp\n2\tx\teth\n3\t0.25\t\n")
    assert [r["line"] for r in files.packet_rows(spark, str(d / "p.tsv")).collect()] == ["tcp  elapsed=0.500000s", "frame  elapsed=0.250000s"]
    assert files.inside(str(d), str(tmp_path)) and not files.inside("/etc", str(tmp_path))
    out = str(tmp_path / "out")
    for k in (1, 2, 1):
        files.write_partitions(spark.createDataFrame([(k, "v")], "k int, v string"), out, ["k"])
    assert spark.read.parquet(out).count() == 2
    valid = files.signature_valid("s")
    import hashlib
    import hmac

    good = "sha256=" + hmac.new(b"s", b"body", hashlib.sha256).hexdigest()
    b = spark.createDataFrame([("body", good), ("body", "sha256=0"), (None, None)], "b string, g string")
    assert [r[0] for r in b.select(valid("b", "g")).collect()] == [True, False, False]


def test_views(spark, small):
    assert "step_timings" in files.register(spark, small)
    assert spark.sql("select count(*) from step_timings").first()[0] > 0


def test_labels_paths_addresses(spark):
    df = spark.createDataFrame([("dissect_nas_attach", "epan/packet-nas.c"), ("diameter_ccr", "x/tcp.c"), ("anything", "y.c"), ("gtp_echo", "GTP/a.c")], "l string, p string")
    hints = text_rules.path_hints(F.col("l"))
    assert [r[0] for r in df.select(text_rules.fits_hints(F.col("p"), hints)).collect()] == [True, False, True, True]
    urls = spark.createDataFrame([("https://host.example/own/rep.git",), ("git@host.example:own/rep",), ("own/rep/",), ("nothing",), (None,)], "u string")
    assert [r[0] for r in urls.select(text_rules.repository_of(F.col("u"))).collect()] == ["own/rep", "own/rep", "own/rep", None, None]
    t = spark.createDataFrame([("Cache the dependency", ["No caching", "Missing dependency cache"]), ("zzz", ["a", "b"]), ("x", [])], "t string, p array<string>")
    assert [r[0] for r in t.select(text_rules.nearest_pattern(F.col("t"), F.col("p"))).collect()] == ["Missing dependency cache", "a", None]
    f = spark.createDataFrame([("db/a.py", "c"), ("db/a.py", "c"), ("core/x.py", "c")], "path string, category string")
    assert {(r["file_domain"], r["findings"], r["files"]) for r in text_rules.finding_counts(f).collect()} == {("database", 2, 1), ("backend", 1, 1)}


def test_between_times_takes_continuations(spark):
    lines = ["no time", "x 10:00:00 a", "more", "10:30:00 b", "11:00:00 c", "tail"]
    df = spark.createDataFrame([("f", n, x) for n, x in enumerate(lines)], "file string, line_no long, line string")
    got = flows.between_times(df, "09:00:00", "10:29:00").orderBy("line_no").collect()
    assert [r["line"] for r in got] == ["x 10:00:00 a", "more"]


def test_fleet_ranks_share_ties(spark):
    runs = spark.createDataFrame([(1, 100), (1, 300), (2, 200), (3, 50), (4, None), (5, 1000)], "repository_id long, total_duration_ms long")
    got = {r["repository_id"]: (r["rank_no"], r["percentile"]) for r in timings.pipeline_fleet(runs).collect()}
    assert got == {3: (1, 25.0), 1: (2, 75.0), 2: (2, 75.0), 5: (4, 100.0)}
    assert timings.pipeline_fleet(runs.filter("repository_id = 3")).first()["percentile"] is None


def test_ingestion(spark, tmp_path):
    runs = spark.createDataFrame([(1, 7, 1), (2, 7, 1), (3, 7, 2), (4, 9, 1), (5, None, 1), (6, 7, None)], "id long, repository_id long, run_number int")
    known = spark.createDataFrame([(7, 2)], "repository_id long, run_number int")
    tracked = spark.createDataFrame([(7,)], "id long")
    assert [r["id"] for r in ingest.new_runs(runs, known, tracked).collect()] == [1]
    steps = spark.createDataFrame([(1, 1, "a", 5), (2, 1, "b", 9), (3, 1, "c", 9), (4, 1, "d", None), (5, None, "x", 1)], "id long, pipeline_run_id long, step_name string, duration_ms long")
    assert [tuple(r) for r in ingest.run_summaries(steps).collect()] == [(1, 4, 23, "b", 9)]
    path = str(tmp_path / "batches")
    assert ingest.read_batches(spark, path, "runs") is None
    ingest.write_batch({"runs": runs, "steps": steps}, path, "one")
    runs.write.parquet(f"{path}/runs/batch=torn")  # no mark: an interrupted write
    assert ingest.read_batches(spark, path, "runs").count() == 6 and ingest.read_batches(spark, path, "steps").count() == 5
    ingest.write_batch({"runs": runs.limit(1), "steps": steps.limit(0)}, path, "one")
    assert ingest.read_batches(spark, path, "runs").count() == 1
    rows = [("a", "(?P<func>x)"), ("a", "(?P<func>x)"), ("a", "(broken"), ("a", "(broken"), ("a", "(broken"), ("b", "(broken"), (None, "x"), ("c", None), ("c", " ")]
    got = ingest.best_patterns(spark.createDataFrame(rows, "app_name string, custom_pattern string"))
    assert [tuple(r) for r in got.collect()] == [("a", "(?P<func>x)", 2)]
    saved = tmp_path / "runs.json"
    saved.write_text('{"workflow_runs": [{"id": 5, "run_number": 2, "name": "CI", "status": "completed", "conclusion": null, "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T00:01:30Z", "repository": {"full_name": "a/b"}}]}')
    (run,) = ingest.run_metadata(spark, str(saved)).collect()
    assert (run["github_run_id"], run["full_name"], run["total_duration_ms"], run["conclusion"]) == (5, "a/b", 90_000, None)


def test_steps_meet_functions_by_name_then_path(spark):
    steps = spark.createDataFrame([("Run migrate_all",), ("execute Deploy",), ("Step ci",), ("run nothing here",), (None,)], "step_name string")
    index = spark.createDataFrame([(2, "do_migrate_all", "a/x.py"), (1, "migrate_all_now", "a/y.py"), (3, "f", "tools/Deploy/z.py"), (4, None, None)], "id long, function_name string, file_path string")
    got = {r["step_name"]: (r["function_id"], r["confidence"]) for r in linkage.step_matches(steps, index).collect()}
    assert got == {"Run migrate_all": (1, 0.5), "execute Deploy": (3, 0.3), "Step ci": (None, None), "run nothing here": (None, None)}


def test_labels_of_a_protocol_meet_its_files_first(spark):
    names = spark.createDataFrame([("a", "gtpv2_create_session_request")], "app_name string, name string")
    index = spark.createDataFrame([(1, "a", "create_session_req_tcp", "src/tcp.c", 1), (2, "a", "create_session_req_any", "src/packet-gtpv2.c", 1)], "id long, app_name string, function_name string, file_path string, line_number int")
    assert linkage.match_names(names, index).first()["function_id"] == 2


def test_files_show_their_risks(spark):
    row = spark.createDataFrame([("a.py", "eval(x); exec (y)")], "p string, t string").select(text_rules.security_hits(F.col("p"), F.col("t")).alias("h")).first()
    assert row["h"] == ["a.py: possible eval injection", "a.py: dynamic exec"]
