"""Runs of consecutive events of the same function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latchline.operators.ordered import CHUNK, placed_with_neighbour, with_neighbour
from latchline.session import stored
from latchline.tables import broadcast_if_small, micros

#: What a logged name begins with: the name as code spells it, before anything added per call.
NAME_HEAD = r"^[\p{L}\p{N}_$]+"


def name_key(c: Column) -> Column:
    """Key of a logged function name: outer blanks, letter case and additions per call removed."""
    return F.lower(F.regexp_extract(F.trim(c), NAME_HEAD, 0))


def known_functions(records: DataFrame, sessions: DataFrame, index: DataFrame, session: str, name: str, to: str) -> DataFrame:
    """Adds ``to``: the id of the indexed function of the session's app that ``name`` means, or null."""
    apps = sessions.select(F.col("id").alias("_sid"), F.col("app_name").alias("_app"))
    keyed = index.select(F.col("app_name").alias("_app"), F.lower("function_name").alias("_key"), F.col("id").alias(to))
    keyed = keyed.groupBy("_app", "_key").agg(F.min(to).alias(to))
    return (
        records.withColumn("_key", name_key(F.col(name)))
        .join(apps, records[session] == F.col("_sid"), "left")
        .join(broadcast_if_small(keyed), ["_app", "_key"], "left")
        .drop("_app", "_key", "_sid")
    )


def event_runs(
    records: DataFrame,
    session: str,
    place: str,
    row_id: str,
    same: str,
    at: str,
    gap_us: int = 60_000_000,
    chunk: int = CHUNK,
) -> DataFrame:
    """All runs ``(session, first_line_no, last_line_no, run_length, span_ms)``, single events included.

    Events of a session, each ``place`` once (lowest ``row_id``), in order of
    ``place``.  Only boundary rows are kept: events whose ``same`` differs from their
    predecessor's or that lie more than ``gap_us`` from it.  ``lead`` over the
    boundaries gives counts as differences of positions and the end of a run as the
    event before the next boundary.

    A null ``session`` or ``place`` means the event has no place and is left out; a
    null ``same`` or ``at`` joins no run, each such event stands alone (its span is
    null without a time); an empty table gives no rows; extra columns are ignored.
    """
    rows = records.select(
        F.col(session).alias("_s"), F.col(place).alias("_p"), F.col(row_id).alias("_id"), F.col(same).alias("_f"), micros(F.col(at)).alias("_t")
    ).filter("_s is not null and _p is not null")
    rows = rows.withColumn("_c", F.floor(F.col("_p") / chunk))
    inside = Window.partitionBy("_s", "_c").orderBy("_p", "_id")
    once = rows.withColumn("_b", F.lag("_p").over(inside)).filter("_b is null or _b <> _p").drop("_b")
    key, order = ["_s"], ["_p", "_id"]
    # Written once, five narrow columns: names are looked up and repeats dropped once for all passes below.
    once = stored(once, "runs-events")
    key, order = ["_s"], ["_p", "_id"]
    near = placed_with_neighbour(once, key, "_c", order, {"_pf": "_f", "_pt": "_t", "_pp": "_p"}, "_n")
    together = (F.col("_f") == F.col("_pf")) & (F.abs(F.col("_t") - F.col("_pt")) <= gap_us)
    starts = near.filter(~F.coalesce(together, F.lit(False)))
    starts = with_neighbour(starts, key, "_c", order, {"_nn": "_n", "_et": "_pt", "_ep": "_pp"}, step=-1)
    final = once.groupBy("_s").agg(F.max_by(F.struct("_t", "_p"), F.struct("_p", "_id")).alias("_l"), F.count(F.lit(1)).alias("_all"))
    starts = starts.join(final, "_s")
    open_end = F.col("_nn").isNull()
    end_t = F.when(open_end, F.col("_l._t")).otherwise(F.col("_et"))
    end_p = F.when(open_end, F.col("_l._p")).otherwise(F.col("_ep"))
    length = F.coalesce("_nn", F.col("_all") + 1) - F.col("_n")
    return starts.select(
        F.col("_s").alias(session),
        F.col("_p").cast("long").alias("first_line_no"),
        end_p.cast("long").alias("last_line_no"),
        length.cast("long").alias("run_length"),
        F.floor((end_t - F.col("_t")) / 1000).cast("long").alias("span_ms"),
    )
