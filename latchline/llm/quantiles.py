"""Mergeable percentiles with multiplicative rank error (relative-error compactors)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Section size; see ``rank_error``.
K = 64
SECTIONS = 3
#: Sketches a task holds before it hands them on.
HELD = 20_000


def rank_error(k: int = K) -> float:
    """Stated relative rank error: the rank of an answer at quantile q is within ``rank_error * (1 - q) * n`` of q * n, plus one.

    From the usual analysis of these compactors the standard error at rank r from the
    protected end is below ``0.084 * 12 / k * r`` with three sections; four of them are stated.
    """
    return min(1.0, 4 * 0.084 * 12 / k)


_WORD = (1 << 64) - 1
#: Layout of a stored sketch: section size, values, seed, least and greatest value, levels.
_HEAD = "<iqQddi"


def _mixed(x: int) -> int:
    """A 64-bit integer with all its bits stirred (the finaliser of a public generator)."""
    x = (x + 0x9E3779B97F4A7C15) & _WORD
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _WORD
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _WORD
    return x ^ x >> 31


class Compactor:
    """One level: a sorted-on-demand buffer whose upper tail is protected."""

    __slots__ = ("items", "sections", "size", "state")

    def __init__(self, k: int, sections: int = SECTIONS, state: int = 0, items: np.ndarray | None = None):
        self.size, self.sections, self.state = k, sections, state
        self.items = np.empty(0) if items is None else items

    def room(self) -> int:
        return 2 * self.size * self.sections


class RelativeSketch:
    """Levels of relative compactors; an item of level h stands for 2**h values.

    The largest values are never compacted away, so high percentiles are the most
    accurate.  Coins come from the sketch's seed and the state of the level: sketches of
    different parts toss different coins, so that their errors cancel when they are merged,
    and a repeated task repeats its result.
    """

    def __init__(self, k: int = K, seed: int = 0):
        self.k, self.n, self.seed = k, 0, seed & _WORD
        self.low, self.high = np.inf, -np.inf
        self.levels = [Compactor(k)]

    def add(self, values: np.ndarray) -> None:
        values = values[~np.isnan(values)]
        if not len(values):
            return
        self.n += len(values)
        self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
        step = self.levels[0].room()
        for i in range(0, len(values), step):
            lv = self.levels[0]
            lv.items = np.concatenate([lv.items, values[i : i + step]])
            self._compress()

    def merge(self, other: RelativeSketch) -> None:
        self.n += other.n
        self.seed = _mixed(self.seed ^ other.seed)
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        while len(self.levels) < len(other.levels):
            self.levels.append(Compactor(self.k))
        for mine, theirs in zip(self.levels, other.levels, strict=False):
            mine.items = np.concatenate([mine.items, theirs.items])
            mine.state |= theirs.state
            if theirs.sections > mine.sections:
                mine.sections, mine.size = theirs.sections, theirs.size
        self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            lv = self.levels[h]
            while len(lv.items) >= lv.room():
                if h + 1 == len(self.levels):
                    self.levels.append(Compactor(self.k))
                up = self.levels[h + 1]
                up.items = np.concatenate([up.items, self._compact(lv, h)])
            h += 1

    def _compact(self, lv: Compactor, h: int) -> np.ndarray:
        """Halves the lower part of a full level; how much of it follows the trailing ones of the state."""
        lv.items.sort()
        ones = 0
        while lv.state >> ones & 1:
            ones += 1
        sections = min(ones + 1, lv.sections)
        keep = lv.room() // 2 + (lv.sections - sections) * lv.size
        part = len(lv.items) - keep
        part -= part & 1
        low, lv.items = lv.items[:part], lv.items[part:]
        coin = _mixed(self.seed ^ _mixed(lv.state * 64 + h)) & 1
        lv.state += 1
        if lv.state >= 1 << (lv.sections - 1) and lv.size >= 8:
            lv.sections, lv.size = lv.sections * 2, max(4, int(lv.size / 2**0.5) & ~1)
        return low[coin::2]

    def quantiles(self, qs: list[float]) -> list[float]:
        """Values at ranks ``ceil(q * n)`` (1 at least) of what was added."""
        if not self.n:
            return [float("nan")] * len(qs)
        items = np.concatenate([lv.items for lv in self.levels])
        weights = np.concatenate([np.full(len(lv.items), 1 << h, dtype=np.int64) for h, lv in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        # Ranks are counted from the protected upper end.
        above = np.cumsum(weights[order][::-1])[::-1]
        out = []
        for q in qs:
            rank = max(1, int(np.ceil(q * self.n)))
            from_top = self.n - rank + 1
            i = np.searchsorted(-above, -from_top, "right") - 1
            out.append(float(items[order][max(i, 0)]))
        return [min(max(x, self.low), self.high) for x in out]

    def dump(self) -> bytes:
        out = [struct.pack(_HEAD, self.k, self.n, self.seed, self.low, self.high, len(self.levels))]
        for lv in self.levels:
            out.append(struct.pack("<iiqi", lv.size, lv.sections, lv.state, len(lv.items)))
            out.append(np.asarray(lv.items, dtype="<f8").tobytes())
        return b"".join(out)

    @classmethod
    def load(cls, data: bytes) -> RelativeSketch:
        k, n, seed, low, high, count = struct.unpack_from(_HEAD, data)
        out, at = cls(k, seed), struct.calcsize(_HEAD)
        out.n, out.low, out.high, out.levels = n, low, high, []
        for _ in range(count):
            size, sections, state, length = struct.unpack_from("<iiqi", data, at)
            at += struct.calcsize("<iiqi")
            out.levels.append(Compactor(size, sections, state, np.frombuffer(data, "<f8", length, at).copy()))
            at += 8 * length
        return out


def _partial(keys: list[str], k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, RelativeSketch] = {}
        task = TaskContext.get()
        part = task.partitionId() if task else 0

        def out() -> pd.DataFrame:
            frame = pd.DataFrame(list(held), columns=keys)
            frame["_sketch"] = [s.dump() for s in held.values()]
            held.clear()
            return frame

        for b in batches:
            if b.empty:
                continue
            codes = b.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            values = b["_v"].to_numpy(dtype=float)[order]
            heads = b[keys].iloc[order[starts]].itertuples(index=False, name=None)
            for head, part in zip(heads, np.split(values, starts[1:]), strict=True):
                key = tuple(None if pd.isna(x) else x for x in head)
                if (sketch := held.get(key)) is None:
                    sketch = held[key] = RelativeSketch(k, zlib.crc32(repr((part, key)).encode()))
                sketch.add(part)
            if len(held) >= HELD:
                yield out()
        if held:
            yield out()

    return run


def _merge_sorted(keys: list[str]):
    """Merges neighbouring sketches of the same key; holds one sketch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, sketch = None, None
        for b in batches:
            done_keys, done = [], []
            heads = b[keys].itertuples(index=False, name=None)
            for head, data in zip(heads, b["_sketch"], strict=True):
                key = tuple(None if pd.isna(x) else x for x in head)
                if sketch is not None and key == current:
                    sketch.merge(RelativeSketch.load(data))
                    continue
                if sketch is not None:
                    done_keys.append(current)
                    done.append(sketch.dump())
                current, sketch = key, RelativeSketch.load(data)
            if done:
                yield pd.DataFrame(done_keys, columns=keys).assign(_sketch=done)
        if sketch is not None:
            yield pd.DataFrame([current], columns=keys).assign(_sketch=[sketch.dump()])

    return run


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of ``keys`` from any finer ones: days into months, partitions into one.

    A key has at most one partial sketch per task and finer key, and a task merges them
    as a stream, so a key that holds most of the rows sends no more than others.
    """
    kinds = dict(sketches.dtypes)
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    placed = sketches.select(*keys, "_sketch").repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInPandas(_merge_sorted(keys), f"{shape}, _sketch binary")


def sketch_values(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """One partial sketch per task and key: ``keys, _sketch``.  Null values and NaN don't count; null keys are a key."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    kinds = dict(rows.dtypes)
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    return rows.mapInPandas(_partial(keys, k), f"{shape}, _sketch binary")


def percentiles(sketches: DataFrame, keys: list[str], qs: dict[str, float]) -> DataFrame:
    """``keys, n``, the least and greatest value and a column per quantile of ``qs`` from merged sketches."""
    names = list(qs)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keys].copy()
            loaded = [RelativeSketch.load(x) for x in b["_sketch"]]
            out["n"] = [s.n for s in loaded]
            out["lowest"] = [s.low for s in loaded]
            out["highest"] = [s.high for s in loaded]
            got = [s.quantiles(list(qs.values())) for s in loaded]
            for i, name in enumerate(names):
                out[name] = [g[i] for g in got]
            yield out

    kinds = dict(sketches.dtypes)
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    return sketches.mapInPandas(read, f"{shape}, n bigint, lowest double, highest double, " + ", ".join(f"{n} double" for n in names))
