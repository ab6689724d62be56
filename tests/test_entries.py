from datetime import datetime

from latchline.functions.earley import Grammar, spans
from latchline.functions.loglines import LAYOUTS, _text_tokens, read_header
from latchline.operators.entries import log_entries

LINES = {
    "2025-09-08 13:49:07.068  Info 927 --- [pool-2-thread-7] c.e.app.TileCache : queue depth 64": ("INFO", "c.e.app.TileCache", "queue depth 64"),
    "\x1b[0m2025-11-04 04:02:09.886  \x1b[31mDEBUG\x1b[0m [worker-3] c.e.TileCache - slot - 88\r": ("DEBUG", "c.e.TileCache", "slot - 88"),
    "L:INFO D:2024-06-04 19:34:12.067 F:com.app.IndexSync(105) FN:fetch_token TI:main C:Store R:a R:b": ("INFO", "fetch_token", "a R:b"),
    "D:2024-06-04 19:34:15.019 L:Critical C:IndexSync F:IndexSync.java(122) Fn:fetch_token T:io-1 R:x": ("FATAL", "fetch_token", "x"),
    "2024-02-22 11:15:21,821 - app.decode - NOTICE - rollover": ("INFO", "app.decode", "rollover"),
    "2023-02-06T13:54:37.2833715Z ##[error]bad": ("ERROR", "", "bad"),
    "2023-02-06T13:54:37.2833715Z fine": ("", "", "fine"),
    "E0704 16:03:16.590088   38976 route_quota.go:762] plan; 78 left": ("ERROR", "route_quota.go", "plan; 78 left"),
    "[Thu Aug 14 00:37:39.737399 2025] [compact:severe] [pid 46822] worker-53 - idle": ("ERROR", "compact", "worker-53 - idle"),
    "01.10.2025 03:48:48 | Warn     | mergeQueue | a | b": ("WARN", "mergeQueue", "a | b"),
    "<130>Apr  8 22:02:33 node28 orderhub[6452]: cache: 10%": ("FATAL", "orderhub", "cache: 10%"),
    "Dec  5 12:18:10 10.0.0.7 relay[30415]: retry": ("", "relay", "retry"),
    "1762228965.273 W commit_quota: peer closed": ("WARN", "commit_quota", "peer closed"),
    'lvl=warn time=2024-09-01T13:54:19.314+05:30 message="limit \\"47\\" reached" func=hydrate trace=20': ("WARN", "hydrate", 'limit "47" reached'),
    '{"n":1,"msg":"r\\u00e9essai \\u2192 done","logger":"scan","severity":"SEVERE","@timestamp":1747183824532,"x":{"a":[1,{}]}}': ("ERROR", "scan", "réessai → done"),
}


def test_layouts():
    for line, want in LINES.items():
        got = read_header(line, 2024)
        assert got and got[1:4] == want, (line, got)
    assert read_header("<130>Apr  8 22:02:33 n a[1]: m", 2023)[0] == int(datetime(2023, 4, 8, 22, 2, 33).timestamp() - datetime(1970, 1, 1).timestamp()) * 1_000_000
    assert read_header("2023-02-06T13:54:37.2833719Z x", 2024)[0] % 1_000_000 == 283371


def test_no_headers():
    for line in (None, "", "   ", "\tat c.e.A.b(C.java:1)", "    2025-03-30 17:56:59.667  INFO [w] c.e.A - copy", "> I0426 22:14:50.295163   37870 a.go:1] copy", "\t| 1705995164.569 W h: copy", "Traceback (most recent call last):", "{", "}", '  "level": "INFO"', "SELECT id", "x" * 200_000, "2025-02-30 10:00:00.000  INFO [w] c.A - no date"):
        assert read_header(line, 2024) is None, line


def test_unparsed_rest_is_given():
    assert read_header('{"ts":"2024-01-01T00:00:00Z","msg":"a"} tail', 2024)[4] == "tail"


def test_longer_headers_win():
    for n in range(1, 61):
        thread = " ".join(f"part{k}" for k in range(n))
        got = read_header(f"2025-11-04 04:02:09.886  DEBUG [{thread}] c.e.TileCache - slot - 88", 2024)
        assert got[1:4] == ("DEBUG", "c.e.TileCache", "slot - 88"), n
    deep = "/".join(f"a:{k}" for k in range(40))
    assert read_header(f"2025-09-08 13:49:07.068  INFO 927 --- [{deep}] c.A : m", 2024)[1:4] == ("INFO", "c.A", "m")
    for line, want in {
        "2025-11-04 04:02:09,886 [main] INFO com.x.Foo - hello": ("INFO", "com.x.Foo", "hello"),
        "[2025-09-08 13:49:07] INFO foo: hello": ("INFO", "foo", "hello"),
        "[2025-09-08 13:49:07] hello": ("", "", "hello"),
        "2024-02-22T11:15:21+0530 WARN some.mod: hey": ("WARN", "some.mod", "hey"),
    }.items():
        assert read_header(line, 2024)[1:4] == want, line


def test_continuations_are_parsed_as_such():
    for line in ("\tat x", "  2025-11-04 04:02:09.886  DEBUG [w] c.A - m", "> 2025-11-04 04:02:09.886  DEBUG [w] c.A - m", "Caused by: x"):
        found, _ = LAYOUTS.parse(_text_tokens(line, []))
        assert found.accepted[1][3][0][0] == "Continuation"


def test_unparsed_header_parts_of_text_are_given():
    got = read_header("2025-11-04 04:02:09.886 DEBUG [worker-3 c.e.TileCache slot 88", 2024)
    assert got[1] == "DEBUG" and got[4].startswith("[worker-3 c.e.TileCache") and got[3].startswith("[worker-3")


def test_grammar_keeps_the_heaviest_parse():
    g = Grammar("S -> A : 0.3\nS -> B : 0.7\nA -> x : 1\nB -> x : 1", "S")
    score, tree = g.best(["x"])
    assert spans(tree, frozenset("AB")) == [("B", 0, 1)]
    assert g.best(["y"]) is None
    nested = Grammar("S -> ( S ) : 0.5\nS -> x : 0.5", "S")
    assert nested.best(list("((x))"))[1][2] == 5


def test_entries(spark):
    boot = "2024-05-01 10:00:00.{:03d}  INFO [w] c.A - m{}"
    rows = [(7, 1, 1, "tail of something", "x"), (1, 1, 2, boot.format(1, 1), "x"), (9, 1, 2, boot.format(1, 1), "x"), (2, 1, 3, "\tat x", "x"), (3, 1, 4, None, "x"), (4, 1, 6, boot.format(2, 2), "x"), (5, 2, 1, "Dec  1 00:00:00 h p[1]: y", "x"), (6, 2, None, boot.format(3, 3), "x"), (8, None, 1, boot.format(4, 4), "x"), (10, 3, 1, "nothing", "x")]
    lines = spark.createDataFrame(rows, "line_id long, session_id long, line_no long, raw_line string, message string")
    sessions = spark.createDataFrame([(1, datetime(2024, 5, 2)), (2, datetime(2021, 1, 1))], "id long, created_at timestamp_ntz")
    for chunk in (1 << 17, 2):
        got = {(r["session_id"], r["first_line_no"]): r for r in log_entries(lines, sessions, excerpts=True, chunk=chunk).collect()}
        assert {k: (r["last_line_no"], r["message"]) for k, r in got.items()} == {(1, 2): (4, "m1"), (1, 6): (6, "m2"), (2, 1): (1, "y")}
        assert got[(1, 2)]["log_excerpt"].endswith("m1\n\tat x")
        assert got[(2, 1)]["entry_us"] == 1638316800_000_000
    assert log_entries(lines.limit(0), sessions).count() == 0


def test_excerpts_by_characters_not_lines(spark):
    head = "2024-05-01 10:00:00.001  INFO [w] c.A - " + "m" * 3000
    rows = [(1, 1, 1, "2024-05-01 10:00:00.001  INFO [w] c.A - m")] + [(n, 1, n, "abcdefghi") for n in range(2, 400)] + [(400, 1, 400, head), (401, 1, 401, "rest")]
    lines = spark.createDataFrame(rows, "line_id long, session_id long, line_no long, raw_line string")
    sessions = spark.createDataFrame([(1, datetime(2024, 5, 2))], "id long, created_at timestamp_ntz")
    got = {r["first_line_no"]: r for r in log_entries(lines, sessions, excerpts=True, chunk=64).collect()}
    assert got[1]["log_excerpt"] == "\n".join(r[3] for r in rows[:399])[:2000] and got[1]["last_line_no"] == 399
    assert got[400]["raw_line"] == head and got[400]["log_excerpt"] == head[:2000] and got[400]["last_line_no"] == 401
