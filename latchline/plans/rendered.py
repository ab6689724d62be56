"""Round trips: the events table written as log lines of each format, parsed back, and held against the events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latchline.operators import flows, runtime_logs
from latchline.operators.ci_logs import archive_steps
from latchline.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _events(spark: SparkSession, root: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, root, "events").withColumn("n", F.row_number().over(order).cast("long"))
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), "n", F.concat(F.lit("do_"), F.col("event_type")).alias("name"), F.col("ts").cast("timestamp").alias("at"), (F.col("value") * 10).cast("long").alias("ms"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _lines(e: DataFrame, *texts: Column) -> DataFrame:
    """Each event as one or more lines of its file."""
    k = len(texts)
    lines = e.select("file", "n", F.posexplode(F.array(*texts)).alias("_k", "line"))
    return lines.select("file", ((F.col("n") - 1) * k + F.col("_k") + 1).alias("line_no"), "line")


def _twin(line: str, precision: str, part: str = "", name: str = "'do_' || event_type", ms: str = "trunc(value * 10)::bigint") -> str:
    """The events as the parser should give them; ``line``: the line number from n; ``precision``: of the time."""
    at = {"ms": "epoch_us(ts) // 1000 * 1000", "s": "epoch_us(date_trunc('second', ts))", "none": "null::bigint"}[precision]
    return f"""with e as (select *, row_number() over (partition by user_id order by ts, event_id) n from events)
select 'u' || user_id as file, ({line})::bigint as line_no, {name} as func_name, row_number() over (partition by user_id, event_type order by n)::bigint as call_number,
  {ms} as duration_ms, ({at})::bigint as timestamp_us from e{part}"""


def round_trip(name: str, sql: str):
    def add(render: Callable[[DataFrame], DataFrame], parse: Callable[[DataFrame], DataFrame]) -> None:
        def run(spark: SparkSession, root: str) -> DataFrame:
            return parse(render(_events(spark, root))).drop("raw_line")

        run.__doc__ = f"Events as {name} lines and back."
        QUERIES[f"round_trip_{name}"] = run
        SQL[f"round_trip_{name}"] = sql

    return add


def _iso() -> Column:
    return F.date_format("at", ISO)


def _n() -> Column:
    return F.col("name")


def _ms() -> Column:
    return F.col("ms")


round_trip("json", _twin("n", "ms"))(lambda e: _lines(e, _text('{"fn":"', _n(), '","took_ms":', _ms(), ',"ts":"', _iso(), '"}')), runtime_logs.parse_json)
round_trip("logfmt", _twin("n", "ms"))(lambda e: _lines(e, _text("ts=", _iso(), ' msg="a b" func=', _n(), " duration=", _ms(), "ms")), runtime_logs.parse_logfmt)
round_trip("syslog", _twin("n", "s"))(lambda e: _lines(e, _text(F.date_format("at", "MMM dd HH:mm:ss"), " host app[7]: ", _n(), " took ", _ms(), "ms")), lambda d: runtime_logs.parse_syslog(d, year=2024))
round_trip("spring", _twin("n", "ms"))(lambda e: _lines(e, _text(F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS"), "  INFO [main] c.e.S - ", _n(), "() in ", _ms(), "ms")), runtime_logs.parse_spring)
round_trip("tshark", _twin("n", "none"))(lambda e: _lines(e, _text(_n(), "   elapsed=", _ms(), "ms")), runtime_logs.parse_tshark)
round_trip("heuristic", _twin("n", "ms"))(lambda e: _lines(e, _text(_iso(), " ", _n(), " took ", _ms(), "ms")), runtime_logs.parse_heuristic)
round_trip("enter_exit", _twin("2 * n", "ms"))(
    lambda e: _lines(e, _text(_iso(), " [ENTER] ", _n()), _text(F.date_format(F.timestamp_micros(F.unix_micros("at") + F.col("ms") * 1000), ISO), " [EXIT] ", _n())), runtime_logs.parse_enter_exit
)
round_trip("tagged", _twin("n", "ms", part=" where trunc(value * 10) > 0"))(
    lambda e: _lines(e, _text("L:INFO D:", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS"), " F:com.x.M(1) FN:", _n(), " TI:main C:Core R:completed in ", _ms(), " ms")), runtime_logs.parse_tagged
)
round_trip("rails", _twin("3 * n", "s", name="'Do#' || event_type"))(
    lambda e: _lines(
        e, _text('Started GET "/', _n(), '" for 127.0.0.1 at ', F.date_format("at", "yyyy-MM-dd HH:mm:ss"), " +0000"), _text("Processing by Do#", F.substring("name", 4, 99), " as JSON"), _text("Completed 200 OK in ", _ms(), "ms")
    ),
    runtime_logs.parse_rails,
)
round_trip("custom", _twin("n", "ms"))(
    lambda e: _lines(e, _text("<", _iso(), "> ", _n(), " => ", _ms(), " ms")), lambda d: runtime_logs.parse_custom(d, r"<(?P<timestamp>\S+)> (?P<func>\w+) => (?P<duration>\d+) (?P<unit>ms)")
)


def _pair(e: DataFrame, enter: tuple[Column | str, ...], leave: tuple[Column | str, ...], pattern: str = ISO) -> DataFrame:
    """Each event as a line where it begins and one where it ends; ``AT`` in the parts stands for their time."""
    end = F.timestamp_micros(F.unix_micros("at") + F.col("ms") * 1000)
    filled = lambda parts, at: _text(*[F.date_format(at, pattern) if isinstance(x, str) and x == "AT" else x for x in parts])
    return _lines(e, filled(enter, F.col("at")), filled(leave, end))


SYSLOG_CLOCK = "MMM dd HH:mm:ss.SSS"
round_trip("json_pairs", _twin("2 * n", "ms"))(
    lambda e: _pair(e, ('{"event":"enter","fn":"', _n(), '","ts":"', "AT", '"}'), ('{"event":"exit","fn":"', _n(), '","ts":"', "AT", '"}')), runtime_logs.parse_json
)
round_trip("logfmt_pairs", _twin("2 * n", "ms"))(
    lambda e: _pair(e, ("ts=", "AT", " event=begin func=", _n()), ("ts=", "AT", " event=finish func=", _n())), runtime_logs.parse_logfmt
)
round_trip("syslog_pairs", _twin("2 * n", "ms"))(
    lambda e: _pair(e, ("AT", " host app[7]: ", _n(), "() enter"), ("AT", " host app[7]: ", _n(), "() return"), SYSLOG_CLOCK), lambda d: runtime_logs.parse_syslog(d, year=2024)
)
round_trip("spring_bracket", _twin("n", "ms"))(lambda e: _lines(e, _text(F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS"), "  INFO [main] c.e.S - ", _n(), " (", _ms(), "ms)")), runtime_logs.parse_spring)
round_trip("tshark_rows", _twin("n", "none", ms="greatest(trunc((trunc(value * 10) / 1000)::double * 1000)::bigint, 1)"))(
    lambda e: _lines(e, _text((_ms() / 1000).cast("double"), "\t", _n(), "\tx")), runtime_logs.parse_tshark
)
# A file named as one format and written in none is read by the plain parser.
round_trip("fallback", _twin("n", "ms"))(lambda e: _lines(e, _text(_iso(), " ", _n(), " took ", _ms(), "ms")), runtime_logs.parse_spring)

#: Formats by the remainder of a user's number: files of all of them in one table, told apart and routed.
ROUTED = ("json", "logfmt", "spring", "enter_exit", "heuristic", "tagged", "rails")
_RENDERED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "json": lambda e: _lines(e, _text('{"fn":"', _n(), '","took_ms":', _ms(), ',"ts":"', _iso(), '"}')),
    "logfmt": lambda e: _lines(e, _text("ts=", _iso(), ' msg="a b" func=', _n(), " duration=", _ms(), "ms")),
    "spring": lambda e: _lines(e, _text(F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS"), "  INFO [main] c.e.S - ", _n(), "() in ", _ms(), "ms")),
    "enter_exit": lambda e: _pair(e, ("AT", " [ENTER] ", _n()), ("AT", " [EXIT] ", _n())),
    "heuristic": lambda e: _lines(e, _text(_iso(), " ", _n(), " took ", _ms(), "ms")),
    "tagged": lambda e: _lines(e, _text("L:INFO D:", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS"), " F:com.x.M(1) FN:", _n(), " TI:main C:Core R:completed in ", _ms(), " ms")),
    "rails": lambda e: _lines(
        e, _text('Started GET "/', _n(), '" for 127.0.0.1 at ', F.date_format("at", "yyyy-MM-dd HH:mm:ss"), " +0000"), _text("Processing by Do#", F.substring("name", 4, 99), " as JSON"), _text("Completed 200 OK in ", _ms(), "ms")
    ),
}


def _routed_sql() -> str:
    kinds = {"enter_exit": ("2 * n", "ms", "'do_' || event_type"), "rails": ("3 * n", "s", "'Do#' || event_type")}
    parts = []
    for i, name in enumerate(ROUTED):
        line, precision, func = kinds.get(name, ("n", "ms", "'do_' || event_type"))
        more = " and trunc(value * 10) > 0" if name == "tagged" else ""
        log_format = "radcom" if name == "tagged" else name
        twin = _twin(line, precision, f" where user_id % {len(ROUTED)} = {i}{more}", func)
        parts.append(f"select *, '{log_format}' as log_format from ({twin})")
    return " union all ".join(parts)


def round_trip_routed(spark: SparkSession, root: str) -> DataFrame:
    """Events as files of seven formats in one table, told apart, routed to their parsers and back."""
    e = _events(spark, root)
    kind = F.substring("file", 2, 99).cast("long") % len(ROUTED)
    lines = None
    for i, name in enumerate(ROUTED):
        part = _RENDERED[name](e.filter(kind == i))
        lines = part if lines is None else lines.unionByName(part)
    return runtime_logs.parse_lines(lines).drop("raw_line")


QUERIES["round_trip_routed"] = round_trip_routed
SQL["round_trip_routed"] = _routed_sql()


# ---- archives of CI logs


ARCHIVE_SQL = """
with s as (select pipeline_run_id file, id, step_name, started_at a, ended_at e, status, row_number() over (partition by pipeline_run_id order by id) n
  from step_timings where pipeline_run_id is not null and started_at is not null and ended_at >= started_at and step_name is not null)
select file::varchar file, n::bigint section_no, step_name, n::int step_number, (4 * n - 2)::bigint first_line_no, (4 * n)::bigint last_line_no, 3::bigint as lines, epoch_us(a) started_us, epoch_us(e) ended_us,
  (epoch_us(e) - epoch_us(a)) // 1000 duration_ms, case when status = 'failure' then 'failure' else 'success' end status, case when status = 'failure' then 'error' else 'warning' end annotation,
  'begin' || chr(10) || '##[warning]slow' || chr(10) || case when status = 'failure' then '##[error]failed' else 'done' end log_excerpt
from s"""


def round_trip_archive(spark: SparkSession, root: str) -> DataFrame:
    """Step timings as archives of CI logs, a section a step, and back."""
    s = table(spark, root, "step_timings").filter("pipeline_run_id is not null and started_at is not null and ended_at >= started_at and step_name is not null")
    s = s.select(F.col("pipeline_run_id").cast("string").alias("file"), "id", "step_name", F.col("started_at").cast("timestamp").alias("a"), F.col("ended_at").cast("timestamp").alias("e"), "status")
    s = s.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("id")).cast("long"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    last = F.when(F.col("status") == "failure", "##[error]failed").otherwise("done")
    texts = _lines(s, _text("=== build/", F.col("n"), "_", F.col("step_name"), ".txt ==="), _text(stamp("a"), " begin"), _text(stamp("a"), " ##[warning]slow"), _text(stamp("e"), " ", last))
    return archive_steps(texts)


QUERIES["round_trip_archive"] = round_trip_archive
SQL["round_trip_archive"] = ARCHIVE_SQL


# ---- flows


FLOWS_SQL = """
with e as (select *, row_number() over (partition by user_id order by ts, event_id) n from events)
select 'u' || user_id as file, row_number() over (partition by user_id order by n)::int flow_id, 't' || n as trace_id, trunc(value * 10) / 1000 as seconds from e where n % 3 <> 0
"""


def round_trip_flows(spark: SparkSession, root: str) -> DataFrame:
    """Events as flows of marked lines, every third one broken, and back."""
    e = _events(spark, root)
    clock = lambda c: F.concat(F.lit(" T : "), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssSSSSSS"))
    end = F.timestamp_micros(F.unix_micros("at") + F.col("ms") * 1000)
    middle = [F.lit(m) for m in flows.SEQUENCE]
    middle[2] = F.when(F.col("n") % 3 == 0, flows.BREAKS[1]).otherwise(flows.SEQUENCE[2])
    lines = _lines(e, _text(flows.BEGIN, " traceId: t", F.col("n"), clock(F.col("at"))), *middle, _text(flows.COUNTS, clock(end)), F.lit("noise"))
    return flows.flow_durations(lines).select("file", "flow_id", "trace_id", "seconds")


QUERIES["round_trip_flows"] = round_trip_flows
SQL["round_trip_flows"] = FLOWS_SQL
