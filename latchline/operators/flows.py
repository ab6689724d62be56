"""Ordered flows in event logs: a fixed sequence of markers, and how long each flow took."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latchline.functions.units import any_of, first_of
from latchline.operators.ordered import CHUNK, with_position, with_running

# Markers of the flow that loads a trace, in order, what breaks it, and what may follow its end.
BEGIN = "[console-function || loadTrace]"
PROGRESS = "[console-function || progressAndStatistics]"
LIST = "[packet-related || list]"
LADDER = "[console-function || calculateLadderDiagram]"
COUNTS = "[console-function || calculatePacketsCounts]"
TIME_REF = "[console-function || timeRefNumber]"
SEQUENCE = (PROGRESS, LIST, LADDER, PROGRESS, COUNTS, PROGRESS, TIME_REF, COUNTS)
BREAKS = ("[console-function || iograph]", "[console-function || closeTrace]", "[no-trace || validateFilter]")
TAIL = (COUNTS, "[No match] datamsmanager")
CLOCK = r"T\s*:\s*\d{4}-\d{2}-\d{2}T(\d{2}):(\d{2}):(\d{2})(\d{6})"
TRACE = r"traceId[:=]\s*([a-zA-Z0-9]+)"


def flow_bounds(places: list[int], lines: list[str]) -> list[tuple[int, int]]:
    """First and last place of every complete flow; a broken one is given up at the next begin.

    ``lines`` are those with a marker, ``places`` where they stand in the file.
    """
    holds = {m: [p for p, x in zip(places, lines, strict=True) if m in x] for m in {BEGIN, *SEQUENCE}}
    broken = [p for p, x in zip(places, lines, strict=True) if any(b in x for b in BREAKS)]
    tails = {p for p, x in zip(places, lines, strict=True) if any(t in x for t in TAIL)}
    out: list[tuple[int, int]] = []
    for start in holds[BEGIN]:
        if out and start <= out[-1][1]:
            continue
        at = start
        for marker in SEQUENCE:
            following = holds[marker]
            k = bisect_right(following, at)
            b = bisect_right(broken, at)
            if k == len(following) or (b < len(broken) and broken[b] < following[k]):
                break
            at = following[k]
        else:
            while at + 1 in tails:
                at += 1
            out.append((start, at))
    return out


def _file_flows(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_p")
    number = dict(zip(pdf["_p"].tolist(), pdf["line_no"].tolist(), strict=True))
    found = flow_bounds(list(number), pdf["line"].tolist())
    return pd.DataFrame({"file": pdf["file"].iloc[0], "flow_id": range(1, len(found) + 1), "from_line": [number[a] for a, _ in found], "to_line": [number[b] for _, b in found]})


def trace_flows(lines: DataFrame) -> DataFrame:
    """``(file, flow_id, from_line, to_line)``: complete flows of each file, in order.

    The automaton skips ahead greedily, so a file's marked lines, few among many, are scanned
    together with their places; its other lines are numbered where they are and stay there.
    Null lines match nothing; lines without file or number are left out; empty tables give no rows.
    """
    marked = (BEGIN, *dict.fromkeys(SEQUENCE), *BREAKS, *TAIL)
    rows = lines.filter("file is not null and line_no is not null").select("file", F.col("line_no").cast("long").alias("line_no"), "line")
    rows = rows.withColumn("_c", F.floor(F.col("line_no") / CHUNK))
    slim = with_position(rows, ["file"], "_c", ["line_no"], "_p").filter(any_of(*[F.col("line").contains(m) for m in marked])).select("file", "line_no", "line", "_p")
    return slim.groupBy("file").applyInPandas(_file_flows, f"file {dict(rows.dtypes)['file']}, flow_id int, from_line long, to_line long")


def clock_us(line: Column) -> Column:
    """Microseconds since midnight of a line's clock, null without one."""
    part = lambda g: F.nullif(F.regexp_extract(line, CLOCK, g), F.lit("")).cast("long")
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1_000_000 + part(4)


def flow_durations(lines: DataFrame) -> DataFrame:
    """First and last clock of each flow, its seconds (past midnight a day is added) and its trace."""
    flows = trace_flows(lines)
    inside = flows.join(lines.filter("line is not null"), "file").filter((F.col("line_no") >= F.col("from_line")) & (F.col("line_no") <= F.col("to_line")))
    at = clock_us(F.col("line"))
    known = F.when(at.isNotNull(), F.col("line_no"))
    trace = F.when(F.col("line").contains(BEGIN), first_of(F.regexp_extract("line", TRACE, 1)))
    g = inside.groupBy("file", "flow_id").agg(F.min_by(at, known).alias("start_us"), F.max_by(at, known).alias("end_us"), F.min_by(trace, F.when(trace.isNotNull(), F.col("line_no"))).alias("trace_id"))
    delta = F.col("end_us") - F.col("start_us")
    return g.withColumn("seconds", F.when(delta < 0, delta + 86_400_000_000).otherwise(delta) / 1e6)


def tagged_fields(line: Column) -> list[Column]:
    """Fields of a key:value tagged line, null where missing."""
    get = lambda key: F.nullif(F.trim(F.regexp_extract(line, rf"(?i)(?<!\w){key}:\s*(.*?)(?=\s+(?:FN|TI|C|R|L|F|D|T):|$)", 1)), F.lit(""))
    return [get(k).alias(k.lower()) for k in ("FN", "TI", "C", "R", "L", "F")]


def between_times(lines: DataFrame, low: str, high: str) -> DataFrame:
    """Lines whose time of day lies in the range; lines without a time go with the line before that has one.

    Lines with a time number the stretches of the file; a stretch takes its first line's time.
    """
    stamp = F.nullif(F.regexp_extract("line", r"\b(\d{2}:\d{2}:\d{2})\b", 1), F.lit(""))
    rows = lines.filter("file is not null and line_no is not null").withColumn("_t", stamp).withColumn("_c", F.floor(F.col("line_no") / CHUNK))
    rows = with_running(rows, ["file"], "_c", ["line_no"], F.col("_t").isNotNull().cast("long"), "_k")
    kept = rows.filter(F.col("_t").between(low, high)).select("file", "_k")
    return rows.join(kept, ["file", "_k"], "left_semi").drop("_t", "_c", "_k")


# The shapes of request paths and what each asks for; the function is the part in brackets.
REQUESTS = (
    (r"^/data/packets/[^/]+/([^/]+)", "packet-related"),
    (r"^/data/[^/]+/([^/]+)", "console-function"),
    (r"^/data/([^/]+)$", "no-trace"),
)
# Components whose lines don't count.
SYSTEM, METRICS = "System", "metrics"


def last_request(line: Column) -> tuple[Column, Column]:
    """Kind and function of the last data request a line names, its commas and dots dropped; null without one."""
    paths = F.regexp_extract_all(F.regexp_replace(line, "[,.]", ""), F.lit(r"(/data\S*)"), F.lit(1))
    path = F.try_element_at(paths, F.lit(-1))
    kind = F.coalesce(*[F.when(path.rlike(shape), name) for shape, name in REQUESTS])
    func = F.coalesce(*[F.when(path.rlike(shape), F.regexp_extract(path, shape, 1)) for shape, _ in REQUESTS])
    return kind, func


def counted_components(lines: DataFrame, component: str) -> DataFrame:
    """Lines of components that count: named, not the system's own and not of metrics."""
    c = F.col(component)
    return lines.filter(c.isNotNull() & (c != "") & (c != SYSTEM) & ~F.lower(c).contains(METRICS))
