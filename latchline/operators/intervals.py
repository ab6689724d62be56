"""Continuous periods and gaps of overlapping, nested and idle intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latchline.operators.ordered import with_neighbour, with_position
from latchline.tables import micros

#: Width of the time buckets that split a large entity (one hour).
BUCKET_US = 3_600_000_000
#: Boundaries of an entity are paired in chunks of so many ranks.
RANK_CHUNK = 1 << 16


def periods_and_gaps(
    df: DataFrame,
    entity: str,
    started: str,
    ended: str,
    bucket_us: int = BUCKET_US,
    rank_chunk: int = RANK_CHUNK,
) -> DataFrame:
    """Periods and gaps per entity: ``(entity, span_kind, from_us, to_us)``.

    Starts and ends are sorted independently and ranked within time buckets, with
    bucket counts carried forward, so no entity is sorted in one task.  The n-th end
    is followed by a gap exactly if the (n+1)-th start lies after it; the boundaries
    on both sides of the gaps are the periods.

    Rows with a null entity, a null end or an end not after the start are no
    intervals and contribute nothing; touching intervals form one period; repeated
    rows change nothing; an empty table gives no rows; other columns are ignored.
    """
    rows = df.select(
        F.col(entity).alias("_e"), micros(F.col(started)).alias("_s"), micros(F.col(ended)).alias("_t")
    ).filter("_e is not null and _s is not null and _t is not null and _t > _s")

    # One row a boundary: starts and ends are two orders of the same table, read once.
    ends = F.explode(F.array(F.struct(F.lit(0).alias("_kind"), F.col("_s").alias("_v")), F.struct(F.lit(1).alias("_kind"), F.col("_t").alias("_v"))))
    bounds = rows.select("_e", ends.alias("_x")).select("_e", "_x.*").withColumn("_b", F.floor(F.col("_v") / bucket_us))
    ranked = with_position(bounds, ["_e", "_kind"], "_b", ["_v"], "_k")
    start = F.col("_kind") == 0
    # The n-th end meets the start after the n-th.
    borders = ranked.groupBy("_e", (F.col("_k") - (F.lit(1) - F.col("_kind"))).alias("_k")).agg(
        F.max(F.when(start, F.col("_v"))).alias("_next"), F.max(F.when(~start, F.col("_v"))).alias("_end")
    )
    # k = 0 holds the first start only, k = n the last end only.
    borders = borders.filter("_next is null or _end is null or _next > _end")
    borders = borders.withColumn("_c", F.floor(F.col("_k") / rank_chunk))
    paired = with_neighbour(borders, ["_e"], "_c", ["_k"], {"_from": "_next"})
    span = lambda kind, a, b: F.struct(F.lit(kind).alias("span_kind"), F.col(a).alias("from_us"), F.col(b).alias("to_us"))
    gap: Column = F.when(F.col("_next").isNotNull() & F.col("_end").isNotNull(), span("gap", "_end", "_next"))
    period: Column = F.when(F.col("_end").isNotNull(), span("period", "_from", "_end"))
    return (
        paired.select(F.col("_e").alias(entity), F.explode(F.array(period, gap)).alias("_x"))
        .filter("_x is not null")
        .select(entity, "_x.*")
    )
