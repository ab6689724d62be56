"""Values as people read them: durations, percentages and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is shown for no value; scores from which health is good or fair.
NOTHING, GOOD, FAIR = "-", 80, 50


def short_ms(ms: Column) -> Column:
    """Seconds with one decimal (halves up) from a second on, else milliseconds."""
    tenths = F.floor((ms + 50) / 100)
    seconds = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s"))
    return F.when(ms.isNull(), NOTHING).when(ms >= 1000, seconds).otherwise(F.concat(ms.cast("string"), F.lit("ms")))


def long_ms(ms: Column) -> Column:
    """Hours, minutes and whole seconds; leading parts that are 0 are left out, negative values are nothing."""
    total = F.floor((ms + 500) / 1000)
    part = lambda value, unit, shown: F.when(shown, F.concat(value.cast("string"), F.lit(unit)))
    hours, minutes = part(F.floor(total / 3600), "h", total >= 3600), part(F.floor(total % 3600 / 60), "m", total >= 60)
    return F.when(ms.isNull() | (ms < 0), NOTHING).otherwise(F.concat_ws(" ", hours, minutes, part(total % 60, "s", F.lit(True))))


def bar_percent(ms: Column, target: Column) -> Column:
    """Width of a bar in percent of the longer of itself and its target."""
    return ms / F.greatest(ms, target) * 100


def bar_color(ms: Column, usual: Column, high: Column) -> Column:
    """Red above the high percentile, amber above the usual one; unknown bounds colour nothing."""
    return F.when(ms > high, "red").when(ms > usual, "amber").otherwise("green")


def health_color(score: Column) -> Column:
    """Green from 80, amber from 50 on; scores lie between 0 and 100, no score is 0."""
    s = F.greatest(F.least(F.coalesce(score, F.lit(0)), F.lit(100)), F.lit(0))
    return F.when(s >= GOOD, "green").when(s >= FAIR, "amber").otherwise("red")
