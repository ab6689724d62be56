"""Access to the stored tables and the few facts about them that plans rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latchline.session import ensure_utc


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return ensure_utc(spark).read.parquet(f"{root}/{name}.parquet")


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a stored timestamp (with or without zone; UTC session)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


#: Rows and bytes (as JSON text) a dimension may have at most to be broadcast unasked.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only after checking that it has at most ``rows`` rows and ``size`` bytes.

    The check stops after ``rows + 1`` rows; a larger side is returned as it is and
    the optimiser chooses a shuffled join.
    """
    seen = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()
    return F.broadcast(df) if seen["n"] <= rows and (seen["b"] or 0) <= size else df
