"""Mixed timestamp notations and zones, normalised to one UTC instant."""

from __future__ import annotations

import hashlib
import inspect
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latchline.functions import timeparse
from latchline.functions.timeparse import candidates
from latchline.operators.ordered import CHUNK, with_last, with_neighbour
from latchline.session import folder_exists, shared_dir, stored
from latchline.tables import broadcast_if_small, micros

DAY_US = 86_400_000_000
READING = "array<struct<first_us:bigint,second_us:bigint>>"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        read = [
            [{"first_us": one, "second_us": two} for one, two in candidates(raw, zone, int(year) if year == year and year is not None else None)]
            for raw, zone, year in zip(b["_raw"], b["_zone"], b["_year"], strict=True)
        ]
        yield pd.DataFrame({"_raw": b["_raw"], "_zone": b["_zone"], "_year": b["_year"], "_readings": read})


def dictionary_path(spark: SparkSession) -> str:
    """Where the dictionary is kept from run to run: below the setting ``latchline.dictionary.dir``, else the shared folder.

    What the parser reads may change with its code, so each version of it has its own.
    """
    version = hashlib.sha256(inspect.getsource(timeparse).encode()).hexdigest()[:16]
    return f"{(spark.conf.get('latchline.dictionary.dir', None) or shared_dir(spark)).rstrip('/')}/latchline-instants-{version}"


def reading_dictionary(values: DataFrame, path: str) -> DataFrame:
    """The dictionary of all distinct ``(_raw, _zone, _year)`` and their readings, unreadable ones with none.

    Only keys that the dictionary below ``path`` lacks are parsed, and they are added
    to it, so each notation is read once over all runs that share ``path``.  Every run
    adds a folder of its own; keys that two runs added at once count once.
    """
    spark = values.sparkSession
    keys = values.select("_raw", "_zone", "_year").distinct()
    shape = f"_raw string, _zone string, _year int, _readings {READING}"
    known = lambda: spark.read.schema(f"{shape}, run string").parquet(path).drop("run")
    fresh = keys
    if folder_exists(spark, path):
        k = known().select(*[F.col(c).alias(f"{c}_k") for c in keys.columns])
        fresh = keys.join(k, [keys[c].eqNullSafe(k[f"{c}_k"]) for c in keys.columns], "left_anti")
    fresh.mapInPandas(_parse, shape).write.mode("overwrite").parquet(f"{path}/run={uuid.uuid4().hex}")
    return known().groupBy("_raw", "_zone", "_year").agg(F.first("_readings").alias("_readings"))


def normalise_instants(
    df: DataFrame,
    row_id: str,
    session: str,
    seq: str,
    raw: str,
    zone: str,
    created: str,
    dictionary: str | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """One UTC instant per readable value: ``(row_id, started_us)``.

    Distinct raw strings with zone and year of the session go through a dictionary that is parsed
    exhaustively once and kept below ``dictionary`` from run to run (``dictionary_path`` by
    default).  A missing year or an unclear day and month is settled by the
    24 hours before ``created``; a wall time that occurred twice is the earliest
    reading not before the preceding readable call of the session.

    Null, empty, very long or unreadable texts give no row; repeated rows each give
    one; a null ``session`` or ``seq`` means no preceding call is known; without a
    zone the value is UTC; without ``created`` yearless values are unreadable and
    unclear dates are read month first.  Extra columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(row_id).alias("_id"),
        F.col(session).alias("_session"),
        F.col(seq).alias("_seq"),
        F.col(raw).alias("_raw"),
        F.coalesce(F.col(zone), F.lit("UTC")).alias("_zone"),
        micros(F.col(created)).alias("_made"),
        F.year(F.col(created)).cast("int").alias("_year"),
    ).filter(F.col("_raw").isNotNull() & (F.trim("_raw") != ""))
    words = reading_dictionary(rows, dictionary or dictionary_path(spark))
    joined = rows.join(
        words.filter("size(_readings) > 0").select("_raw", "_zone", F.col("_year").alias("_y"), "_readings"),
        (rows["_raw"] == words["_raw"]) & (rows["_zone"] == words["_zone"]) & rows["_year"].eqNullSafe(F.col("_y")),
    ).select("_id", "_session", "_seq", "_made", "_readings")
    # Distance of a reading from the 24 hours before the session was made; 0 inside.
    off = lambda c: F.when(F.col("_made").isNull() | c.isNull(), 0).otherwise(
        F.greatest(F.col("_made") - DAY_US - c, c - F.col("_made"), F.lit(0))
    )
    scored = F.transform(
        "_readings",
        lambda r, i: F.struct(
            F.when(r["second_us"].isNull(), off(r["first_us"])).otherwise(F.least(off(r["first_us"]), off(r["second_us"]))).alias("off"),
            i.alias("place"),
            r.alias("reading"),
        ),
    )
    picked = joined.withColumn("_r", F.array_min(scored)["reading"]).select(
        "_id", "_session", "_seq", F.col("_r.first_us").alias("_one"), F.col("_r.second_us").alias("_two")
    )
    # Written once: the passes below read five narrow columns instead of joining the dictionary again.
    picked = stored(picked, "instants-read")
    alone = picked.filter("_session is null or _seq is null").select("_id", F.col("_one").alias("_us"))
    placed = picked.filter("_session is not null and _seq is not null")
    return (
        _settle_repeats(placed, chunk)
        .unionByName(alone)
        .select(F.col("_id").alias(row_id), F.col("_us").cast("long").alias("started_us"))
    )


def _settle_repeats(placed: DataFrame, chunk: int) -> DataFrame:
    """Choose between the two instants of repeated wall times.

    Within a stretch of twice-occurring calls the first instants stand until one
    would fall before its predecessor; from there on the second instants stand, for
    they lie after every first one.  A call with one instant ends the stretch.
    """
    # Sessions without any twice-occurring value need no order.
    doubtful = broadcast_if_small(placed.filter("_two is not null").select("_session").distinct())
    calls = placed.join(doubtful, "_session", "left_semi").groupBy("_session", "_seq").agg(F.min_by(F.struct("_one", "_two"), "_id").alias("_c"))
    calls = calls.select("_session", "_seq", "_c.*", F.floor(F.col("_seq") / chunk).alias("_chunk"))
    order = (["_session"], "_chunk", ["_seq"])
    near = with_neighbour(calls, *order, {"_prev": "_one"})
    # A call with one instant ends a stretch, a fall turns to the second instants, other calls change nothing.
    turn = F.when(F.col("_two").isNull(), 0).when(F.col("_one") < F.col("_prev"), 1)
    late = with_last(near, *order, turn, "_late").filter("_two is not null and _late = 1").select("_session", "_seq", F.lit(True).alias("_late"))
    # A repeated delivery takes the same choice; where its text differs its own instants count.
    return placed.join(broadcast_if_small(stored(late, "instants-late")), ["_session", "_seq"], "left").select(
        "_id", F.when(F.coalesce("_late", F.lit(False)) & F.col("_two").isNotNull(), F.col("_two")).otherwise(F.col("_one")).alias("_us")
    )
