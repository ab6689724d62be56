import pytest
from pyspark.sql import functions as F

from latchline.streaming import events as ev
from latchline.tables import table


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    table(spark, "/root/testdata/sf0.001", "events").repartition(3).write.parquet(path)
    return path


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_complete_counts_equal_batch(spark, folder):
    path = folder
    schema = spark.read.parquet(path).schema
    got = drain(ev.windowed_counts(ev.stream(spark, path, schema)), "hours", "complete")
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(path).count()


def test_sessions_close(spark, folder):
    path = folder
    got = drain(ev.user_sessions(ev.stream(spark, path, spark.read.parquet(path).schema)), "sessions")
    assert got.count() > 0


def test_repeated_events_drop(spark, folder):
    path = folder
    rows = ev.stream(spark, path, spark.read.parquet(path).schema)
    twice = rows.unionByName(rows)
    assert drain(ev.first_only(twice, ["event_id"], "40 days"), "once").count() == spark.read.parquet(path).count()


def test_pairs(spark, tmp_path):
    rows = [(1, "f", "enter", "2024-01-01 00:00:00"), (1, "f", "enter", "2024-01-01 00:00:01"), (1, "f", "exit", "2024-01-01 00:00:03"), (1, "f", "exit", "2024-01-01 00:00:04"), (2, "f", "exit", "2024-01-01 00:00:01")]
    df = spark.createDataFrame(rows, "file long, func_name string, kind string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drain(ev.paired_calls(ev.stream(spark, str(tmp_path / "in"), df.schema)), "pairs")
    assert [(r["file"], r["func_name"], r["duration_ms"]) for r in got.collect()] == [(1, "f", 2000)]
