"""Queries of the general data-processing problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latchline.operators.entries import log_entries
from latchline.operators.instants import normalise_instants
from latchline.operators.intervals import periods_and_gaps
from latchline.operators.outliers import first_deliveries, implausible_readings
from latchline.tables import table


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return log_entries(table(spark, root, "raw_log_lines"), table(spark, root, "app_log_sessions")).drop("unparsed")


def p4_records(spark: SparkSession, root: str) -> DataFrame:
    """Entries with first line, excerpt and what the grammar left over."""
    return log_entries(table(spark, root, "raw_log_lines"), table(spark, root, "app_log_sessions"), excerpts=True)


def readings(spark: SparkSession, root: str) -> DataFrame:
    """Step timings that count as readings, each delivery once, with repository and run time."""
    steps = table(spark, root, "step_timings").filter("duration_ms is not null and coalesce(status, '') <> 'skipped'")
    same = ["pipeline_run_id", "step_name", "step_number", "duration_ms", "started_at", "ended_at", "status"]
    once = first_deliveries(steps, "id", same, ["annotation", "log_excerpt", "source_function"])
    runs = table(spark, root, "pipeline_runs").select(F.col("id").alias("pipeline_run_id"), "repository_id", "created_at")
    return once.select("id", "pipeline_run_id", "step_name", "duration_ms").join(runs, "pipeline_run_id")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    found = implausible_readings(readings(spark, root), "id", ["repository_id", "step_name"], "duration_ms", "created_at")
    return found.select(F.col("id").alias("step_id"), "flag_kind")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return periods_and_gaps(table(spark, root, "step_timings"), "pipeline_run_id", "started_at", "ended_at")


P6_SQL = """
with v as (select pipeline_run_id r, epoch_us(started_at) s, epoch_us(ended_at) e from step_timings
           where pipeline_run_id is not null and ended_at > started_at),
o as (select *, max(e) over (partition by r order by s, e rows between unbounded preceding and 1 preceding) pm from v),
g as (select *, sum(case when pm is null or s > pm then 1 else 0 end) over (partition by r order by s, e rows unbounded preceding) k from o),
p as (select r, k, min(s) f, max(e) t from g group by r, k),
n as (select *, lead(f) over (partition by r order by k) nf from p)
select r as pipeline_run_id, 'period' as span_kind, f as from_us, t as to_us from n
union all
select r, 'gap', t, nf from n where nf is not null
"""


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    calls = table(spark, root, "parsed_function_calls")
    sessions = table(spark, root, "app_log_sessions").select(F.col("id").alias("session_id"), "host_zone", "created_at")
    rows = calls.join(sessions, "session_id", "left")
    return normalise_instants(rows, "call_id", "session_id", "call_seq", "started_at", "host_zone", "created_at")


def p4_piped(spark: SparkSession, root: str) -> DataFrame:
    """Entries whose first line is of the layout ``dd.mm.yyyy time | LEVEL | component | message`` in plain characters."""
    lines = table(spark, root, "raw_log_lines").filter("session_id is not null and line_no is not null").groupBy("session_id", "line_no").agg(F.min_by("raw_line", "line_id").alias("_raw"))
    lines = lines.filter(F.col("_raw").rlike(PIPED)).select("session_id", F.col("line_no").alias("first_line_no"))
    return p4_found(spark, root).join(lines, ["session_id", "first_line_no"]).select("session_id", "first_line_no", "entry_us", "component", "message")


#: A line of that layout, for Spark and DuckDB alike.
PIPED = r"^(\d\d)\.(\d\d)\.(\d{4}) (\d\d:\d\d:\d\d) \| (?:TRACE|DEBUG|INFO|WARN|ERROR) +\| ([A-Za-z_]\w*) +\| ([ -~]+)$"
P4_SQL = f"""
with o as (select * from raw_log_lines where session_id is not null and line_no is not null qualify row_number() over (partition by session_id, line_no order by line_id) = 1),
m as (select session_id, line_no, regexp_extract(raw_line, '{PIPED}', ['d', 'mo', 'y', 't', 'c', 'm']) g from o)
select session_id, line_no as first_line_no, epoch_us(try_cast(g.y || '-' || g.mo || '-' || g.d || ' ' || g.t as timestamp)) as entry_us, g.c as component, trim(g.m) as message
from m where g.d <> '' and try_cast(g.y || '-' || g.mo || '-' || g.d || ' ' || g.t as timestamp) is not null
"""


def p5_impossible(spark: SparkSession, root: str) -> DataFrame:
    """The impossible readings alone, which SQL can tell."""
    return p5_found(spark, root).filter("flag_kind = 'impossible'").select("step_id")


P5_SQL = """
with s as (select pipeline_run_id, step_name, step_number, duration_ms, started_at, ended_at, status, annotation, log_excerpt, source_function, min(id) id from step_timings
  where duration_ms is not null and coalesce(status, '') <> 'skipped' group by all)
select s.id as step_id from s join pipeline_runs r on r.id = s.pipeline_run_id
where (duration_ms < 0 or duration_ms > 86400000) and step_name is not null and repository_id is not null and r.created_at is not null
"""
#: A notation that names its instant without help.
MARKED = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?(Z|[+-]\d\d:\d\d)$"


def p7_marked(spark: SparkSession, root: str) -> DataFrame:
    """Instants of the values that carry their offset in ISO notation, which SQL can read."""
    calls = table(spark, root, "parsed_function_calls").filter(F.col("started_at").rlike(MARKED)).select("call_id")
    return p7_found(spark, root).join(calls.distinct(), "call_id", "left_semi")


P7_SQL = f"select call_id, epoch_us(try_cast(started_at as timestamptz)) as started_us from parsed_function_calls where regexp_matches(started_at, '{MARKED}') and try_cast(started_at as timestamptz) is not null"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p4_found, p4_records, p4_piped, p5_found, p5_impossible, p6_found, p7_found, p7_marked)
}
SQL: dict[str, str] = {"p4_piped": P4_SQL, "p5_impossible": P5_SQL, "p6_found": P6_SQL, "p7_marked": P7_SQL}
