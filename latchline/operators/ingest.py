"""Taking runs, steps and calls in: what is new, what a run sums up to, and writes that appear whole or not at all."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latchline.session import folder_exists

# Fixed value: characters of an excerpt that are stored.
EXCERPT_CHARS = 2000


def new_runs(runs: DataFrame, known: DataFrame, tracked: DataFrame) -> DataFrame:
    """Runs of tracked repositories that ``known`` lacks, each ``(repository_id, run_number)`` once, the lowest id.

    Runs with a null repository or number can't be told apart and are left out; empty tables give no rows.
    """
    key = ["repository_id", "run_number"]
    rows = runs.filter("repository_id is not null and run_number is not null")
    rows = rows.join(tracked.select(F.col("id").alias("repository_id")).distinct(), "repository_id", "left_semi").join(known.select(*key).distinct(), key, "left_anti")
    first = rows.groupBy(*key).agg(F.min("id").alias("_first"))
    return rows.join(first, key).filter(F.col("id") == F.col("_first")).drop("_first").dropDuplicates([*key])


def run_summaries(steps: DataFrame) -> DataFrame:
    """``pipeline_run_id, steps, total_ms, slowest_step, slowest_ms``; of equally slow steps the first id, null durations count as 0."""
    ms = F.coalesce("duration_ms", F.lit(0))
    rows = steps.filter("pipeline_run_id is not null")
    best = F.max_by(F.struct("step_name", ms.alias("ms")), F.struct(ms, -F.col("id"))).alias("_b")
    got = rows.groupBy("pipeline_run_id").agg(F.count(F.lit(1)).alias("steps"), F.sum(ms).cast("long").alias("total_ms"), best)
    return got.select("pipeline_run_id", "steps", "total_ms", F.col("_b.step_name").alias("slowest_step"), F.col("_b.ms").cast("long").alias("slowest_ms"))


def stored_calls(calls: DataFrame, most: int = EXCERPT_CHARS) -> DataFrame:
    """Calls as they are stored: excerpts cut, everything else as it is."""
    return calls.withColumn("log_excerpt", F.substring("log_excerpt", 1, most))


def write_batch(tables: dict[str, DataFrame], path: str, batch: str) -> None:
    """Writes several tables as one batch, e.g. runs with their steps: readers see all of them or none.

    Every table goes to its own folder of the batch; a mark written last makes the batch
    visible.  A batch written again replaces what an interrupted one left behind.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    spark.range(1).select(F.lit(batch).alias("batch")).write.mode("overwrite").parquet(f"{path}/_batches/{batch}")


def read_batches(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table's rows of all finished batches, None before the first."""
    if not folder_exists(spark, f"{path}/_batches"):
        return None
    done = spark.read.parquet(f"{path}/_batches/*").select("batch").distinct()
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").withColumn("batch", F.col("batch").cast("string")).join(F.broadcast(done), "batch", "left_semi")


def _readable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = []
        for p in b["custom_pattern"]:
            try:
                re.compile(p)
                keep.append(True)
            except re.error:
                keep.append(False)
        yield b[keep]


def best_patterns(sessions: DataFrame) -> DataFrame:
    """``app_name, custom_pattern, used``: the readable pattern that most sessions of an app used, ties by its text.

    Patterns are counted first, so Python reads each distinct one once; apps without a readable pattern have no row.
    """
    rows = sessions.filter("app_name is not null and trim(custom_pattern) <> ''")
    counted = rows.groupBy("app_name", "custom_pattern").agg(F.count(F.lit(1)).alias("used"))
    fine = counted.mapInPandas(_readable, "app_name string, custom_pattern string, used long")
    first = Window.partitionBy("app_name").orderBy(F.desc("used"), "custom_pattern")
    return fine.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def run_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Runs of saved answers ``{"workflow_runs": [...]}`` of a CI service, one row a run, the newest first in no particular order."""
    shape = (
        "workflow_runs array<struct<id:bigint,run_number:int,name:string,status:string,conclusion:string,head_branch:string,head_sha:string,"
        "created_at:timestamp,updated_at:timestamp,repository:struct<full_name:string>>>"
    )
    runs = spark.read.option("multiLine", True).schema(shape).json(path).select(F.explode("workflow_runs").alias("r"))
    return runs.select(
        F.col("r.id").alias("github_run_id"), "r.run_number", F.col("r.name").alias("workflow_name"), "r.status", "r.conclusion", "r.head_branch", "r.head_sha",
        F.col("r.repository.full_name").alias("full_name"), "r.created_at", "r.updated_at",
        ((F.unix_micros("r.updated_at") - F.unix_micros("r.created_at")) / 1000).cast("long").alias("total_duration_ms"),
    )
