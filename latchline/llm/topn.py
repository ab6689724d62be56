"""The N best items of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame

from latchline.session import stored
from latchline.tables import broadcast_if_small

#: Rows kept per group before repeated deliveries are dropped, in multiples of N.
SPARE = 2


def _ranked(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group by score, then lowest id: a group limit before and after the only shuffle."""
    return rows.sparkSession.sql(
        f"select * from (select *, row_number() over (partition by {by} order by score desc, item_id) as r from {{rows}}) where r <= {int(n)}", rows=rows
    ).drop("r")


def top_per_group(df: DataFrame, groups: list[str], score: str, row_id: str, n: int, delivery: str | None = None) -> DataFrame:
    """``groups``, ``rank_no`` and ``row_id`` of the ``n`` rows with the highest score in each group.

    Ties go to the lowest id.  Rows of one group with the same ``delivery`` value are
    repeated deliveries of one item, alike but for the id: the lowest id counts (a
    null ``delivery`` repeats nothing).

    A row number by score and id, filtered to a few rows, becomes a group limit that each task
    applies before the only shuffle and again after it: a group of any size, of equal scores
    too, sends ``SPARE * n`` rows a task.  Among these repeated deliveries are dropped.  Groups
    of which ``n`` items can't be told from so few rows, as most are repeats, are taken
    again from all their rows, each delivery once.

    Rows with a null score or id don't count; a null group value is a group of its
    own; an empty table gives no rows; other columns, also ones named like those added
    here, are ignored.
    """
    spark = df.sparkSession
    keys = [f"g{i}" for i in range(len(groups))]
    by = ", ".join(keys)
    given = ", ".join(f"`{c}` as g{i}" for i, c in enumerate(groups))
    item = f"coalesce(cast(`{delivery}` as string), concat('#', `{row_id}`))" if delivery else f"cast(`{row_id}` as string)"
    names = ", ".join(f"g{i} as `{c}`" for i, c in enumerate(groups))
    items = spark.sql(f"select {given}, `{score}` as score, `{row_id}` as item_id, {item} as item from {{rows}} where `{score}` is not null and `{row_id}` is not null", rows=df)
    if delivery is None:
        best = spark.sql(f"select *, row_number() over (partition by {by} order by score desc, item_id) as r from {{rows}}", rows=_ranked(items, by, n))
        return spark.sql(f"select {names}, cast(r as int) as rank_no, item_id from {{best}}", best=best)
    most = SPARE * n
    # The partitions of the groups serve all windows, so rows are shuffled once.
    best = spark.sql(
        f"""
        select *, row_number() over (partition by {by} order by score desc, item_id) as r from (
          select {by}, score, item_id, taken = {most} and n_items < {int(n)} as unsure from (
            select *, count(*) over (partition by {by}) as taken, count_if(first) over (partition by {by}) as n_items from (
              select *, row_number() over (partition by {by}, score, item order by item_id) = 1 as first from {{high}}))
          where first)
        """,
        high=_ranked(items, by, most),
    )
    best = stored(best.filter(f"r <= {int(n)}"), "top-rows")
    sure = best.filter("not unsure").select(*keys, "r", "item_id")
    unsure = best.filter("unsure").select(*[best[k].alias(f"u_{k}") for k in keys]).distinct()
    if not unsure.isEmpty():
        side = broadcast_if_small(unsure)
        again = items.join(side, [items[k].eqNullSafe(side[f"u_{k}"]) for k in keys], "left_semi")
        # Every delivery once, spread by item: no group is collected.
        once = again.groupBy(*keys, "item", "score").agg({"item_id": "min"}).withColumnRenamed("min(item_id)", "item_id")
        sure = sure.unionByName(
            spark.sql(f"select {by}, item_id, row_number() over (partition by {by} order by score desc, item_id) as r from {{rows}}", rows=_ranked(once.select(*keys, "score", "item_id"), by, n))
        )
    return spark.sql(f"select {names}, cast(r as int) as rank_no, item_id from {{sure}}", sure=sure)
