"""Neighbour look-ups and running numbers over ordered groups of any size.

A window over a key that holds a third of all rows would sort that third in one
task.  The helpers here split every group into chunks of its order column, run
the window inside the chunks and carry only one row per chunk across the chunk
borders, so the largest task holds one chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a chunk in units of the order column (lines, calls, ...).
CHUNK = 1 << 17


def with_neighbour(
    df: DataFrame,
    keys: list[str],
    chunk: str,
    order: list[str],
    fields: dict[str, str],
    step: int = 1,
) -> DataFrame:
    """Add ``fields`` (new name -> source column) of the row ``step`` (1 before, -1 after).

    ``chunk`` is a column that never decreases along ``order`` within ``keys``.
    ``keys``, ``chunk`` and ``order`` must not be null; rows at the end of a group get null.
    """
    src = list(dict.fromkeys(fields.values()))
    inner = Window.partitionBy(*keys, chunk).orderBy(*order)
    packed = F.struct(*[F.col(c) for c in src])
    ranked = df.withColumn("_near", F.lag(packed, step).over(inner)).withColumn("_mine", packed)
    ranked = ranked.withColumn("_edge", F.lag(F.lit(1), -step).over(inner).isNull())
    side = Window.partitionBy(*keys).orderBy(chunk)
    edges = ranked.filter("_edge").select(*keys, chunk, F.col("_mine"))
    edges = edges.withColumn("_over", F.lag("_mine", step).over(side)).drop("_mine").filter("_over is not null")
    out = ranked.join(edges, [*keys, chunk], "left")
    near = F.coalesce(F.col("_near"), F.col("_over"))
    for name, c in fields.items():
        out = out.withColumn(name, near[c])
    return out.drop("_near", "_mine", "_edge", "_over")


def with_position(df: DataFrame, keys: list[str], chunk: str, order: list[str], name: str, total: str | None = None) -> DataFrame:
    """Number the rows of each group 1, 2, ... along ``order``; ``total`` names a column for the group's size."""
    inner = Window.partitionBy(*keys, chunk).orderBy(*order)
    sizes = df.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        sizes = sizes.withColumn(total, F.sum("_n").over(Window.partitionBy(*keys)).cast("long"))
    return (
        df.withColumn("_rn", F.row_number().over(inner))
        .join(sizes.drop("_n"), [*keys, chunk])
        .withColumn(name, (F.col("_rn") + F.col("_before")).cast("long"))
        .drop("_rn", "_before")
    )


def placed_with_neighbour(
    df: DataFrame, keys: list[str], chunk: str, order: list[str], fields: dict[str, str], name: str
) -> DataFrame:
    """``with_neighbour`` (the row before) and ``with_position`` in one pass: one sort, one row a chunk carried on."""
    src = list(dict.fromkeys(fields.values()))
    inner = Window.partitionBy(*keys, chunk).orderBy(*order)
    packed = F.struct(*[F.col(c) for c in src])
    ranked = df.withColumn("_near", F.lag(packed).over(inner)).withColumn("_rn", F.row_number().over(inner))
    ends = df.groupBy(*keys, chunk).agg(F.max_by(packed, F.struct(*order)).alias("_end"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(chunk)
    ends = ends.withColumn("_over", F.lag("_end").over(before))
    ends = ends.withColumn("_before", F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n"))
    out = ranked.join(ends.filter("_over is not null").drop("_end", "_n"), [*keys, chunk], "left")
    out = out.withColumn(name, (F.col("_rn") + F.coalesce("_before", F.lit(0))).cast("long"))
    for new, c in fields.items():
        out = out.withColumn(new, F.coalesce(F.col("_near"), F.col("_over"))[c])
    return out.drop("_near", "_over", "_rn", "_before")


def with_running(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Running sum of ``value`` along ``order``, this row included."""
    inner = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    valued = df.withColumn("_v", value)
    sums = valued.groupBy(*keys, chunk).agg(F.sum("_v").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        valued.withColumn("_rs", F.sum("_v").over(inner))
        .join(sums, [*keys, chunk])
        .withColumn(name, F.coalesce(F.col("_rs"), F.lit(0)) + F.col("_before"))
        .drop("_v", "_rs", "_before")
    )


def with_last(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` along ``order``, this row included."""
    inner = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    valued = df.withColumn("_v", value)
    ends = valued.filter("_v is not null").groupBy(*keys, chunk).agg(F.max_by("_v", F.struct(*order)).alias("_end"))
    # Chunks without a value of their own pass on what came before.
    ends = valued.select(*keys, chunk).distinct().join(ends, [*keys, chunk], "left")
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).drop("_end").filter("_before is not null")
    return (
        valued.withColumn("_l", F.last("_v", ignorenulls=True).over(inner))
        .join(ends, [*keys, chunk], "left")
        .withColumn(name, F.coalesce("_l", "_before"))
        .drop("_v", "_l", "_before")
    )
