"""Implausible measurements per source, relative to the source's own behaviour."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latchline.functions.statespace import (
    VARIED, VARIED_SHARE, ZERO_SHARE, Source, describe, fault_kinds, first_spread, impossible, log_readings, near_counts, run_counts, spread_counts, strays, usual_cells, vanished,
)
from latchline.operators.ordered import with_position
from latchline.session import stored
from latchline.tables import micros

#: Readings of a source that one task filters at a time, and those it sees on either side: far more than the filter remembers.
BLOCK, HALO = 8192, 512
DAY_US = 86_400_000_000


def _whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_k", kind="stable")
    kinds = fault_kinds(pdf["_v"].to_numpy())
    return pd.DataFrame({"_id": pdf["_id"].to_numpy()[kinds != ""], "flag_kind": kinds[kinds != ""].astype(str)})


def _in_blocks(df: DataFrame, keys: list[str], block: int, halo: int) -> DataFrame:
    """Rows ``(keys, _block, _own, ...)``: each block with what lies ``halo`` readings around it."""
    at = F.col("_k")
    blocks = F.sequence(F.greatest(F.floor((at - halo) / block), F.lit(0)), F.floor(F.least(at + halo, F.col("_total") - 1) / block))
    return df.withColumn("_block", F.explode(blocks)).withColumn("_own", F.floor(at / block) == F.col("_block"))


def _key_frame(key: tuple, keys: list[str], n: int) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([key[i]] * n, dtype=object) for i, c in enumerate(keys)})


def _split_sources(rows: DataFrame, keys: list[str], block: int, halo: int) -> DataFrame:
    """Faults of sources of more than ``block`` readings, block by block; what concerns a whole source is summed over its blocks.

    ``rows``: ``keys, _id, _v, _k (from 0), _total``.
    """
    kinds = dict(rows.dtypes)
    named = ", ".join(f"{c} {kinds[c]}" for c in keys)

    def runs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k", kind="stable")
        v, own = pdf["_v"].to_numpy(), pdf["_own"].to_numpy()
        got, bad = run_counts(v, own), impossible(v)
        held = list(got.held.items())
        flagged = np.flatnonzero(own & (bad | vanished(v)))
        out = _key_frame(key, keys, 1 + len(held) + len(flagged))
        none = [None] * len(flagged)
        out["_value"] = [None, *[x for x, _ in held], *none]
        out["_counts"] = [[got.readings, got.rest, got.zero], *[list(c) for _, c in held], *none]
        blank = [None] * (1 + len(held))
        out["_at"] = pd.array([*blank, *pdf["_k"].to_numpy()[flagged].tolist()], dtype="Int64")
        out["_bad"] = [*blank, *bad[flagged].tolist()]
        return out

    blocks = _in_blocks(rows, keys, block, halo)
    seen = stored(blocks.groupBy(*keys, "_block").applyInPandas(runs, f"{named}, _value double, _counts array<bigint>, _at bigint, _bad boolean"), "outliers-runs")
    n = lambda i: F.coalesce(F.sum(F.col("_counts")[i]), F.lit(0))
    held = seen.filter("_value is not null").groupBy(*keys, "_value").agg(n(0).alias("_times"), n(1).alias("_n"))
    held = held.filter("_times > 1").groupBy(*keys).agg(F.max("_n").alias("_most"))
    sums = seen.filter("_value is null and _at is null").groupBy(*keys).agg(n(0).alias("_n"), n(1).alias("_rest"), n(2).alias("_zero"))
    lively = sums.join(held, keys, "left").fillna(0, ["_most"])
    enough = F.col("_rest") >= F.greatest(F.lit(float(VARIED)), F.col("_n") * VARIED_SHARE)
    lively = lively.filter((F.col("_most") * 2 <= F.col("_n")) & enough & (F.col("_zero") <= F.col("_rest") * ZERO_SHARE)).select(*keys, F.lit(True).alias("_lively"))
    flags = seen.filter("_at is not null").join(lively, keys, "left").filter("_bad or _lively")
    flags = flags.select(*keys, F.col("_at").alias("_k"), F.when(F.col("_bad"), "impossible").otherwise("stuck").alias("flag_kind"))
    marked = stored(rows.join(flags, [*keys, "_k"], "left"), "outliers-marked")
    calm = marked.filter("flag_kind is null").withColumn("_chunk", F.floor(F.col("_k") / block)).drop("_total", "flag_kind")
    calm = with_position(calm, keys, "_chunk", ["_k"], "_j", "_total").select(*keys, "_id", "_v", (F.col("_j") - 1).alias("_k"), "_total")
    calm = stored(calm, "outliers-calm")
    sizes = stored(calm.groupBy(*keys).agg(F.first("_total").alias("_total")), "outliers-sizes")
    parts = _in_blocks(calm, keys, block, halo).groupBy(*keys, "_block")

    def facts(df: DataFrame):
        """One row of what is known of the source for each of its blocks."""
        return sizes.join(df, keys).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_total") - 1) / block)))).drop("_total").groupBy(*keys, "_block")

    def read(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values("_k", kind="stable")
        return pdf, log_readings(pdf["_v"].to_numpy()), pdf["_own"].to_numpy()

    def cells(key: tuple, counts: dict[str, dict[int, int]]) -> pd.DataFrame:
        got = [(name, c, n) for name, hist in counts.items() for c, n in hist.items()]
        columns = {c: pd.Series([g[i] for g in got], dtype=object) for i, c in enumerate(("_name", "_cell", "_n"))}
        return _key_frame(key, keys, len(got)).assign(**columns)

    def near(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, y, own = read(pdf)
        return cells(key, {"near": near_counts(y, own)})

    def around(key: tuple, pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        _, y, own = read(pdf)
        return cells(key, spread_counts(y, own, float(known["_first"].iloc[0])) if len(pdf) else {})

    def summed(df: DataFrame, label: str) -> DataFrame:
        return stored(df.groupBy(*keys, "_name", "_cell").agg(F.sum("_n").alias("_n")), label).groupBy(*keys)

    def rough(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _key_frame(key, keys, 1).assign(_first=first_spread(dict(zip(pdf["_cell"].tolist(), pdf["_n"].tolist(), strict=True))))

    def described(key: tuple, pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        counts: dict[str, dict[int, int]] = {k: {} for k in ("residual", "narrow", "one", "many", "level")}
        for name, c, m in zip(pdf["_name"], pdf["_cell"].tolist(), pdf["_n"].tolist(), strict=True):
            counts[name][c] = m
        s = describe(float(known["_first"].iloc[0]), counts)
        return _key_frame(key, keys, 1).assign(_spread=s.spread, _walk=s.walk, _cells=[list(s.levels)], _times=[list(s.levels.values())])

    def judged(key: tuple, pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        pdf, y, own = read(pdf)
        f = known.iloc[0]
        levels = dict(zip(map(int, f["_cells"]), map(int, f["_times"]), strict=True))
        at, cell, far = strays(y, Source(float(f["_spread"]), float(f["_walk"]), sum(levels.values()), levels))
        at, cell, far = at[own[at]], cell[own[at]], far[own[at]]
        return _key_frame(key, keys, len(at)).assign(_id=pdf["_id"].to_numpy()[at], _cell=cell, _far=far)

    def often(key: tuple, pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        f = known.iloc[0]
        usual = usual_cells(dict(zip(pdf["_cell"].tolist(), pdf["_n"].tolist(), strict=True)), Source(float(f["_spread"]), float(f["_walk"]), int(sum(f["_times"]))))
        return _key_frame(key, keys, len(usual)).assign(_cell=usual)

    hist = f"{named}, _name string, _cell bigint, _n bigint"
    first = stored(summed(parts.applyInPandas(near, hist), "outliers-near").applyInPandas(rough, f"{named}, _first double"), "outliers-first")
    counts = summed(parts.cogroup(facts(first)).applyInPandas(around, hist), "outliers-around")
    known = counts.cogroup(first.groupBy(*keys)).applyInPandas(described, f"{named}, _spread double, _walk double, _cells array<bigint>, _times array<bigint>")
    known = stored(known, "outliers-sources")
    stray = stored(parts.cogroup(facts(known)).applyInPandas(judged, f"{named}, _id {kinds['_id']}, _cell bigint, _far boolean"), "outliers-strays")
    times = stored(stray.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n")), "outliers-distances")
    usual = stored(times.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInPandas(often, f"{named}, _cell bigint"), "outliers-usual")
    spiky = stray.filter("_far").join(usual, [*keys, "_cell"], "left_anti").select("_id", F.lit("spike").alias("flag_kind"))
    return marked.filter("flag_kind is not null").select("_id", "flag_kind").unionByName(spiky)


def implausible_readings(
    df: DataFrame, row_id: str, source: list[str], value: str, at: str, block: int = BLOCK, halo: int = HALO
) -> DataFrame:
    """Faulty readings ``(row_id, flag_kind)`` of each source, ordered by ``at`` and id.

    Each source is filtered by local-level Kalman filters whose variances are estimated for it.
    ``impossible``: below 0 or above 24 h.  ``stuck``: six or more readings in a row over which
    the innovation variance vanishes, in a source that otherwise varies.  ``spike``: an
    innovation of more than six ordinary spreads about the forecasts from before and after it,
    flagged readings withheld, at no level the source often returns to.

    A source of more than ``block`` readings is split over tasks: its statistics are sums over
    the blocks, and the filter starts ``halo`` readings ahead of each block, far more than it
    remembers, so the size of the blocks doesn't show in the result.

    Rows with a null id, value, time or source column are no readings; sources of
    fewer than five possible readings have no spikes; ties in time follow the id; an
    empty table gives no rows; extra columns are ignored.
    """
    rows = df.select(
        F.col(row_id).alias("_id"),
        *[F.col(c).alias(f"_s{i}") for i, c in enumerate(source)],
        F.col(value).cast("double").alias("_v"),
        micros(F.col(at)).alias("_t"),
    )
    rows = rows.dropna().withColumn("_b", F.floor(F.col("_t") / DAY_US))
    keys = [f"_s{i}" for i in range(len(source))]
    placed = with_position(rows, keys, "_b", ["_t", "_id"], "_k", "_total").withColumn("_k", F.col("_k") - 1)
    placed = stored(placed.select(*keys, "_id", "_v", "_k", "_total"), "outliers-placed")
    shape = f"_id {dict(rows.dtypes)['_id']}, flag_kind string"
    found = placed.filter(F.col("_total") <= block).drop("_total").groupBy(*keys).applyInPandas(_whole, shape)
    large = placed.filter(F.col("_total") > block)
    if not large.isEmpty():
        found = found.unionByName(_split_sources(large, keys, block, halo))
    return found.select(F.col("_id").alias(row_id), "flag_kind")


def first_deliveries(df: DataFrame, row_id: str, same: list[str], also: list[str] | None = None) -> DataFrame:
    """Of rows alike in ``same`` (and in a hash of ``also``) the one with the lowest id.

    Returns ``same`` and ``row_id``; nulls in ``same`` are alike.
    """
    keys = [F.col(c) for c in same]
    if also:
        keys.append(F.xxhash64(*also).alias("_also"))
    return df.groupBy(*keys).agg(F.min(row_id).alias(row_id)).drop("_also")
