"""Structured Streaming twins of the batch plans over event tables.

All read parquet folders as they fill; times are cast to zoned timestamps because
watermarks need them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def stream(spark: SparkSession, path: str, schema: StructType, at: str = "ts", files: int = 1) -> DataFrame:
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn(at, F.col(at).cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling (or sliding) window and kind; later events than ``late`` are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "n")


def first_only(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Repeated deliveries within the watermark are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def paired_calls(events: DataFrame) -> DataFrame:
    """Calls from enter and exit events ``(file, func_name, kind, ts)`` of a stream.

    The state of a function is its last enter; an exit uses it up.  Events are taken
    in the order of their times within a trigger.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entered = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples():
            if row.kind == "enter":
                entered = int(row.ts.value // 1000)
            elif row.kind == "exit" and entered is not None:
                out.append((key[0], key[1], entered, max(0, (int(row.ts.value // 1000) - entered) // 1000)))
                entered = None
        if entered is None:
            if state.exists:
                state.remove()
        else:
            state.update((entered,))
        yield pd.DataFrame(out, columns=["file", "func_name", "timestamp_us", "duration_ms"])

    return events.groupBy("file", "func_name").applyInPandasWithState(
        step, "file long, func_name string, timestamp_us long, duration_ms long", "entered_us long", "append", GroupStateTimeout.NoTimeout
    )
