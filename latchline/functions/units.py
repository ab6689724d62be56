"""Column expressions for durations, times and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit spellings and their length in milliseconds.
UNITS_MS = {
    1.0: ("ms", "millisecond", "milliseconds", "msec"),
    1000.0: ("s", "sec", "second", "seconds", "secs"),
    0.001: ("us", "µs", "μs", "microsecond", "microseconds"),
    0.000001: ("ns", "nanosecond", "nanoseconds"),
    60000.0: ("m", "min", "minute", "minutes"),
}


def duration_ms(value: Column, unit: Column) -> Column:
    """Whole milliseconds, cut; micro- and nanoseconds give 1 at least; a bad number gives 0, an unknown unit counts as ms."""
    v = F.when(value.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), value.try_cast("double"))
    u = F.lower(F.trim(unit, F.lit(".")))
    # One product and one quotient, so that the value's expression is not repeated per unit.
    times = F.when(u.isin(*UNITS_MS[1000.0]), 1000.0).when(u.isin(*UNITS_MS[60000.0]), 60000.0).otherwise(1.0)
    parts = F.when(u.isin(*UNITS_MS[0.001]), 1000.0).when(u.isin(*UNITS_MS[0.000001]), 1000000.0).otherwise(1.0)
    least = F.when(u.isin(*UNITS_MS[0.001], *UNITS_MS[0.000001]), 1)
    return F.coalesce(F.greatest((v * times / parts).cast("long"), F.when(v.isNotNull(), least)), F.lit(0)).cast("long")


# An ISO time inside a line; what precedes or follows the bare name of a function; protocol prefixes of log labels.
ISO_TIME = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)"
ARGUMENTS, LEADING, MODULE_MARK, CLASS_MARK = r"\(.*\)", "^_+", r"\.", "::"
LABEL_PREFIXES = ("^dissect_", "^(diameter|gtpv2)_")


def iso_us(text: Column) -> Column:
    """Microseconds of an ISO time (UTC without an offset), null if unreadable."""
    spaced = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.unix_micros(spaced.try_cast("timestamp"))


def found_iso_us(line: Column) -> Column:
    """Microseconds of the first ISO time in a line."""
    return iso_us(F.nullif(F.regexp_extract(line, ISO_TIME, 1), F.lit("")))


def syslog_us(month: Column, day: Column, clock: Column, year: int) -> Column:
    """Microseconds of a time without a year; the year is given."""
    m = F.floor((F.position(F.lower(month), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) - 1) / 3) + 1
    stamp = F.format_string("%04d-%02d-%02d %s", F.lit(year), m.cast("int"), day.try_cast("int"), clock)
    return F.unix_micros(stamp.try_cast("timestamp"))


def first_of(*parts: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts])


def bare_name(name: Column) -> Column:
    """A logged name without brackets, leading underscores, module and class prefixes, in lower case."""
    c = F.regexp_replace(F.trim(F.regexp_replace(name, ARGUMENTS, "")), LEADING, "")
    for mark in (MODULE_MARK, CLASS_MARK):
        c = F.element_at(F.split(c, mark), -1)
    return F.lower(c)


# Words of log labels and the form code uses instead; read both ways.
ALIASES = {
    "request": "req", "response": "rsp", "command": "cmd", "failure": "fail", "security": "sec", "information": "info",
    "authentication": "auth", "tls": "ssl", "ssl": "tls", "analysis": "analyze", "analyze": "analysis",
    "retransmission": "retransmit", "retransmit": "retransmission", "check": "verify", "segment": "seq",
}
_FORMS = {w: sorted({v for k, v in ALIASES.items() if k == w} | {k for k, v in ALIASES.items() if v == w}) for w in {*ALIASES, *ALIASES.values()}}


def name_tokens(name: Column) -> Column:
    """Lower-case parts (longer than one character) of a label, its protocol prefix dropped, with their other forms."""
    raw = F.lower(name)
    for prefix in LABEL_PREFIXES:
        raw = F.regexp_replace(raw, prefix, "")
    parts = F.filter(F.split(raw, "[^a-z0-9]+"), lambda x: F.length(x) > 1)
    table = F.create_map(*[x for w, forms in sorted(_FORMS.items()) for x in (F.lit(w), F.array(*[F.lit(f) for f in forms]))])
    more = F.flatten(F.filter(F.transform(parts, lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull()))
    return F.array_distinct(F.concat(parts, more))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of two token arrays, 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def any_of(*tests: Column) -> Column:
    return reduce(lambda x, y: x | y, tests)
