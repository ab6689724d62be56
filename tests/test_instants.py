from datetime import datetime

from latchline.operators import instants
from latchline.functions.timeparse import candidates, utc_text, wall_instants
from latchline.operators.instants import normalise_instants

MADE = datetime(2024, 10, 27, 12)
SCHEMA = "id long, s long, q long, raw string, zone string, made timestamp_ntz, started_us string"


def only(raw, zone="UTC", year=2024):
    (one,) = candidates(raw, zone, year)
    return utc_text(one[0])


def test_notations():
    want = "2024-03-05T06:07:08+00:00"
    for raw in (
        "2024-03-05T06:07:08Z", "2024-03-05 06:07:08", "2024/03/05 06:07:08", "20240305T060708Z", "[20240305060708]", '"05.03.2024 06:07:08"', "Tue, 05 Mar 2024 07:07:08 +0100",
        "05/Mar/2024:06:07:08 +0000", "2024-03-05T01:07:08-05", "2024-03-05 11:52:08 +0545", "1709618828", "1709618828000", "1709618828000000", "1709618828000000000", "2024-03-05 07:07:08 CET", " 2024-03-05 06:07:08 UTC ",
    ):
        assert only(raw) == want, raw
    assert only("2024-03-05 06:07:08,123456789") == "2024-03-05T06:07:08.123456+00:00"
    assert only("1709618828.5") == "2024-03-05T06:07:08.500000+00:00"
    assert only("2024-07-01 12:00:00 EDT", "America/New_York") == "2024-07-01T16:00:00+00:00"


def test_junk_is_unreadable():
    for raw in (None, "", "-", "N/A", "null", "yesterday", "0000-00-00 00:00:00", "2025-02-30 10:00:00", "2024-13-41T25:61:00Z", "2024-0", "T12:", "????-??-?? ??:??:??", "x" * 100_000):
        assert candidates(raw, "UTC", 2024) == [], raw


def test_clock_changes():
    one, two = wall_instants(datetime(2024, 10, 27, 2, 30), "Europe/Berlin")
    assert (utc_text(one), utc_text(two)) == ("2024-10-27T00:30:00+00:00", "2024-10-27T01:30:00+00:00")
    skipped, other = wall_instants(datetime(2024, 3, 31, 2, 30), "Europe/Berlin")
    assert (utc_text(skipped), other) == ("2024-03-31T01:30:00+00:00", None)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = normalise_instants(df, "id", "s", "q", "raw", "zone", "made", **kw)
    assert got.columns == ["id", "started_us"]
    return {i: utc_text(u)[:19] for i, u in got.collect()}


def test_session_order_settles_repeated_hours(spark):
    B = "Europe/Berlin"
    rows = [
        (1, 1, 1, "2024-10-27 02:10:00", B, MADE), (2, 1, 2, "2024-10-27 02:50:00", B, MADE), (3, 1, 3, "2024-10-27 02:20:00", B, MADE), (4, 1, 4, "2024-10-27 02:55:00", B, MADE),
        (5, 1, 5, "2024-10-27T00:05:00Z", B, MADE), (6, 1, 6, "2024-10-27 02:20:00", B, MADE), (7, 1, 6, "2024-10-27 02:20:00", B, MADE),
        (8, 2, 1, "junk", B, MADE), (9, 2, 2, "10/27/2024 01:00:00 AM", None, MADE), (10, None, None, "27/10/2024 03:00:00", None, MADE), (11, 3, 1, "Oct 27 11:00:00", None, MADE), (12, 3, 2, None, None, MADE), (13, 3, 3, "", None, None),
    ]
    want = {
        1: "2024-10-27T00:10:00", 2: "2024-10-27T00:50:00", 3: "2024-10-27T01:20:00", 4: "2024-10-27T01:55:00", 5: "2024-10-27T00:05:00", 6: "2024-10-27T00:20:00", 7: "2024-10-27T00:20:00",
        9: "2024-10-27T01:00:00", 10: "2024-10-27T03:00:00", 11: "2024-10-27T11:00:00",
    }
    assert run(spark, rows) == want
    assert run(spark, rows, chunk=2) == want
    assert run(spark, []) == {}


def test_dictionary_grows_by_unknown_keys_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "words")
    first = [(1, 1, 1, "2024-10-27 05:00:00", "UTC", MADE), (2, 1, 2, "junk 1", "UTC", MADE)]
    run(spark, first, dictionary=path)
    run(spark, [*first, (3, 1, 3, "2024-10-27 06:00:00", "UTC", MADE)], dictionary=path)
    kept = spark.read.parquet(path)
    assert kept.count() == 3 and kept.filter("size(_readings) = 0").count() == 1
    # All is known now: a parser that fails is never called.
    monkeypatch.setattr(instants, "_parse", refuse)
    want = run(spark, [*first, (3, 1, 3, "2024-10-27 06:00:00", "UTC", MADE)], dictionary=path)
    assert want == {1: "2024-10-27T05:00:00", 3: "2024-10-27T06:00:00"}
    # Keys that two runs added at once count once.
    kept.drop("run").write.parquet(f"{path}/run=again")
    assert run(spark, first, dictionary=path) == {1: "2024-10-27T05:00:00"}


def refuse(batches):
    for b in batches:
        assert not len(b)
        yield from ()


def test_further_notations():
    want = "2024-03-05T06:07:08+00:00"
    for raw in ("2024-W10-2T06:07:08Z", "2024-065T06:07:08Z", "05.03.24 06:07:08", "Tue" + " " * 5000 + "2024-03-05" + " " * 5000 + "06:07:08"):
        assert utc_text(candidates(raw, "UTC", 2024)[0][0]) == want, raw
    assert utc_text(candidates("24-03-05 06:07:08", "UTC", 2024)[-1][0]) == want
    for raw in ("2024-W54-1T00:00:00", "2023-366T00:00:00", "13/13/24 00:00:00x", "1" * 100_000):
        assert candidates(raw, "UTC", 2024) == []
