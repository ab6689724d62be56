"""Local-level Kalman filtering of a source's readings (NumPy, one stretch at a time).

Everything a decision needs of the whole source is a sum: counts and histograms of fixed
resolution.  They are the same whether a source is read at once or in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: A day in milliseconds: no step runs longer.
LONGEST_MS = 86_400_000
#: Standardised innovation from which a reading is withheld from the filter.
GATE = 4.5
#: Innovation, in ordinary spreads about the forecasts from both sides, that makes a spike.
SPIKE = 6.0
#: Equal readings in a row whose innovations have vanished, and readings apart from such runs that tell whether a source varies.
STUCK, VARIED = 6, 5
#: A source varies if so large a share lies outside such runs and at most so many innovations there are zero.
VARIED_SHARE, ZERO_SHARE = 0.2, 0.5
#: Share of a source's readings, and least number, that make a second level usual.
SUPPORT_SHARE, SUPPORT_LEAST = 0.075, 4
#: Spread below which log readings count as constant (about 1 %).
LEAST_SPREAD = 0.01
#: Median of the smallest of four differences between standard normal readings and its neighbours, and of one absolute value.
NEAR_MEDIAN, HALF_NORMAL = 0.335, 0.6745
#: Neighbours on either side that tell a reading's level.
AROUND = 7
#: Rough spreads within which neighbours are of one level, and a narrower look; it counts if it gives less than this share.
NEAR_BY, NARROW, MIXED = 4.0, 3.0, 0.4
#: Bounds of the level's walk from reading to reading, in spreads.
WALK = (0.1, 0.5)
#: Histogram cells per unit of log readings: of differences (up to ``FAR``) and of levels.
CELLS, LEVEL_CELLS, FAR = 10_000, 500, 3.0


@dataclass(frozen=True)
class Source:
    """What is known of a whole source."""

    spread: float = LEAST_SPREAD
    walk: float = WALK[0] * LEAST_SPREAD
    readings: int = 0
    levels: dict[int, int] | None = None


def impossible(v: np.ndarray) -> np.ndarray:
    return (v < 0) | (v > LONGEST_MS)


def vanished(v: np.ndarray) -> np.ndarray:
    """Readings among ``STUCK`` or more whose innovations are nil.

    A filter without observation noise forecasts the last reading; over a stretch of
    ``STUCK`` equal readings the variance of its innovations is exactly zero.
    """
    n = len(v)
    out = np.zeros(n, bool)
    if n < STUCK:
        return out
    innovation = np.diff(v)
    energy = np.convolve((innovation != 0).astype(np.int64), np.ones(STUCK - 1, np.int64), "valid")
    for k in range(STUCK):
        out[k : k + len(energy)] |= energy == 0
    return out


@dataclass
class Runs:
    """Own readings of a source, those outside vanished stretches, of these the ones with a zero innovation, and per held value its stretches and readings."""

    readings: int = 0
    rest: int = 0
    zero: int = 0
    held: dict[float, tuple[int, int]] = field(default_factory=dict)


def run_counts(v: np.ndarray, own: np.ndarray) -> Runs:
    gone = vanished(v)
    zero = np.concatenate([[False], v[1:] == v[:-1]])[: len(v)]
    begins, inside = own & gone & ~zero, own & gone
    held = {x: (0, n) for x, n in zip(*(a.tolist() for a in np.unique(v[inside], return_counts=True)), strict=True)}
    for x, n in zip(*(a.tolist() for a in np.unique(v[begins], return_counts=True)), strict=True):
        held[x] = (n, held[x][1])
    return Runs(int(own.sum()), int((own & ~gone).sum()), int((own & ~gone & zero).sum()), held)


def varies(runs: Runs) -> bool:
    """Whether a source otherwise varies, so that a vanished stretch is a fault: its value is none the source keeps coming back to."""
    usual = any(times > 1 and n > runs.readings / 2 for times, n in runs.held.values())
    return not usual and runs.rest >= max(VARIED, VARIED_SHARE * runs.readings) and runs.zero <= ZERO_SHARE * runs.rest


def log_readings(v: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(v, 0.5))


def _counts(x: np.ndarray, cells: int) -> dict[int, int]:
    cell, times = np.unique(np.floor(x * cells).astype(np.int64), return_counts=True)
    return dict(zip(cell.tolist(), times.tolist(), strict=True))


def _median(counts: dict[int, int], cells: int) -> float | None:
    total, upto = sum(counts.values()), 0
    for c in sorted(counts):
        upto += counts[c]
        if 2 * upto >= total:
            return (c + 0.5) / cells
    return None


def near_counts(y: np.ndarray, own: np.ndarray) -> dict[int, int]:
    """Histogram of the distance to the nearest of four neighbours."""
    near = np.full(len(y), np.inf)
    for k in (1, 2):
        if len(y) > k:
            d = np.abs(y[k:] - y[:-k])
            near[k:] = np.minimum(near[k:], d)
            near[:-k] = np.minimum(near[:-k], d)
    return _counts(np.minimum(near[own & np.isfinite(near)], FAR), CELLS)


def first_spread(near: dict[int, int]) -> float:
    """A rough spread, blind to drift, rhythm and second levels."""
    middle = _median(near, CELLS)
    return LEAST_SPREAD if middle is None or sum(near.values()) < 3 else max(middle / NEAR_MEDIAN, LEAST_SPREAD)


def _residuals(y: np.ndarray, own: np.ndarray, first: float, near_by: float) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Distances of own readings from the mean of neighbours within ``near_by`` spreads, and differences over 1 and ``AROUND`` readings."""
    n = len(y)
    total, count, steps = np.zeros(n), np.zeros(n), {}
    for k in range(1, AROUND + 1):
        if n <= k:
            break
        d = y[k:] - y[:-k]
        same = np.abs(d) <= near_by * first
        total[k:] += np.where(same, y[:-k], 0)
        count[k:] += same
        total[:-k] += np.where(same, y[k:], 0)
        count[:-k] += same
        if k in (1, AROUND):
            steps[k] = np.abs(d)[same & own[k:]]
    known = (count > 0) & own
    r = (y[known] - total[known] / count[known]) / np.sqrt(1 + 1 / count[known])
    return np.abs(r[np.abs(r) <= 3.5 * first]), steps


def spread_counts(y: np.ndarray, own: np.ndarray, first: float) -> dict[str, dict[int, int]]:
    """Histograms of residuals from the level of near and of nearer neighbours, of differences over 1 and ``AROUND`` readings, and of levels."""
    wide, steps = _residuals(y, own, first, NEAR_BY)
    narrow, _ = _residuals(y, own, first, NARROW)
    counts = {"residual": wide, "narrow": narrow, "one": steps.get(1, wide[:0]), "many": steps.get(AROUND, wide[:0])}
    return {**{k: _counts(x, CELLS) for k, x in counts.items()}, "level": _counts(y[own], LEVEL_CELLS)}


def describe(first: float, counts: dict[str, dict[int, int]]) -> Source:
    """Spread, walk and levels of a source from its summed histograms."""
    wide, narrow = (first if sum(counts[k].values()) < 3 else max(_median(counts[k], CELLS) / HALF_NORMAL, LEAST_SPREAD) for k in ("residual", "narrow"))
    # A second level near by makes readings look wide; a look at nearer neighbours tells.
    spread = narrow if narrow < MIXED * wide else wide
    one, many = (_median(counts[k], CELLS) for k in ("one", "many"))
    # Var(y[k] - y[k-m]) = 2 * noise + m * walk.
    walk = 0.0 if one is None or many is None else max(many * many - one * one, 0.0) / HALF_NORMAL**2 / (AROUND - 1)
    return Source(spread, float(np.clip(np.sqrt(walk), WALK[0] * spread, WALK[1] * spread)), sum(counts["level"].values()), counts["level"])


def forecasts(y: np.ndarray, source: Source) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forecast of each reading from those before it, its variance, and which readings were withheld.

    A reading whose standardised innovation exceeds the gate doesn't update the state.
    Four withheld readings that agree with one another among the last six are a lasting
    change: the filter starts anew there.
    """
    n = len(y)
    mean, variance, out = np.zeros(n), np.zeros(n), np.zeros(n, bool)
    if n == 0:
        return mean, variance, out
    noise, walk, near_by = source.spread**2, source.walk**2, 4 * source.spread
    gate = GATE * GATE
    level, var = float(np.median(y[: min(n, 9)])), noise
    recent: list[tuple[int, float]] = []
    for i, x in enumerate(y.tolist()):
        var += walk
        mean[i], variance[i] = level, var
        innovation, total = x - level, var + noise
        if innovation * innovation > gate * total:
            out[i] = True
            recent = [(j, r) for j, r in recent if j > i - 6] + [(i, x)]
            near = [r for _, r in recent if abs(r - x) <= near_by]
            if len(near) >= 4:
                level, var, recent = sum(near) / len(near), noise, []
            continue
        gain = var / total
        level += gain * innovation
        var *= 1 - gain
    return mean, variance, out


def strays(y: np.ndarray, source: Source) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Readings more than half of ``SPIKE`` spreads off, their histogram cell by distance, and which may be spikes.

    The filter runs in both directions.  Where its forecasts agree they are weighed by their
    variances; where they don't, the level changed there and the nearer one counts.  A spike is
    withheld by the filter, lies more than ``SPIKE`` spreads off and at no level at which the source often is.
    """
    none = np.zeros(0, np.int64)
    if len(y) < 5:
        return none, none, np.zeros(0, bool)
    before, var_before, one = forecasts(y, source)
    after, var_after, two = (a[::-1] for a in forecasts(y[::-1], source))
    # At either end only one side has seen readings.
    before[0], var_before[0], after[-1], var_after[-1] = after[0], var_after[0], before[-1], var_before[-1]
    level = (before / var_before + after / var_after) / (1 / var_before + 1 / var_after)
    nearer = np.where(np.abs(y - before) <= np.abs(y - after), before, after)
    off = y - np.where(np.abs(before - after) <= 3 * source.spread, level, nearer)
    at = np.flatnonzero(np.abs(off) > SPIKE / 2 * source.spread)
    cell = np.floor(off[at] * LEVEL_CELLS).astype(np.int64)
    far = ((one | two) & (np.abs(off) > SPIKE * source.spread))[at]
    if far.any():
        # Readings within three spreads, this one not counted.
        near = _within(source.levels or {}, np.floor(y[at] * LEVEL_CELLS).astype(np.int64), source)
        far &= ~_often(near, source)
    return at, cell, far


def _within(counts: dict[int, int], cells: np.ndarray, source: Source) -> np.ndarray:
    """For each of ``cells`` the counted readings within three spreads of it."""
    known = np.array(sorted(counts), dtype=np.int64)
    upto = np.concatenate([[0], np.cumsum([counts[c] for c in known.tolist()])])
    wide = int(3 * source.spread * LEVEL_CELLS) + 1
    return upto[np.searchsorted(known, cells + wide, "right")] - upto[np.searchsorted(known, cells - wide, "left")] - 1


def _often(near: np.ndarray, source: Source) -> np.ndarray:
    return near >= max(SUPPORT_LEAST, SUPPORT_SHARE * source.readings)


def usual_cells(counts: dict[int, int], source: Source) -> list[int]:
    """Distances from the level at which the source often is, wherever the level has drifted: rhythms."""
    cells = np.array(sorted(counts), dtype=np.int64)
    return cells[_often(_within(counts, cells, source), source)].tolist()


def fault_kinds(values: np.ndarray) -> np.ndarray:
    """``impossible``, ``stuck``, ``spike`` or '' for each reading of one whole, ordered source."""
    v = np.asarray(values, dtype=np.float64)
    kinds = np.full(len(v), "", dtype=object)
    bad, all_own = impossible(v), np.ones(len(v), bool)
    # An impossible reading is of no run of equal ones, and interrupts it.
    stuck = vanished(v) & ~bad if varies(run_counts(v, all_own)) else np.zeros(len(v), bool)
    kinds[stuck], kinds[bad] = "stuck", "impossible"
    at = np.flatnonzero(~bad & ~stuck)
    y, own = log_readings(v[at]), np.ones(len(at), bool)
    first = first_spread(near_counts(y, own))
    source = describe(first, spread_counts(y, own, first))
    stray, cell, far = strays(y, source)
    usual = usual_cells(dict(zip(*(a.tolist() for a in np.unique(cell, return_counts=True)), strict=True)), source)
    kinds[at[stray[far & ~np.isin(cell, usual)]]] = "spike"
    return kinds
