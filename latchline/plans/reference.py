"""Queries of the analytics engine over the stored tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latchline.functions.stats import interpolated
from latchline.functions.units import ALIASES, bare_name, duration_ms, name_tokens, token_overlap
from latchline.operators import linkage, runtime_logs, timings
from latchline.operators.ci_logs import clean_line, flat_steps
from latchline.operators.ordered import CHUNK, with_neighbour, with_position
from latchline.operators.text_rules import SIGNALS, classify_domain, security_signals, stable_id
from latchline.session import stored
from latchline.tables import micros, table

DAY_US = 86_400_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


HISTORY = """
r as (select id run_id, repository_id, created_at from pipeline_runs),
recent as (select * from r qualify row_number() over (partition by repository_id order by created_at desc, run_id desc) <= 50),
s as (select pipeline_run_id run_id, step_name, id step_id, duration_ms from step_timings where duration_ms is not null and step_name is not null),
named as (select distinct repository_id, step_name from recent join s using (run_id)),
kept as (select * from r join s using (run_id) semi join named using (repository_id, step_name)
  qualify row_number() over (partition by repository_id, step_name order by created_at desc, run_id desc, step_id desc) <= 50),
h as (select *, row_number() over (partition by repository_id, step_name order by created_at, run_id, step_id) - 1 idx from kept),
st as (select repository_id, step_name, count(*) n, avg(duration_ms) mean_ms, case when count(*) >= 2 then stddev_pop(duration_ms) else 0 end std_ms,
  case when count(*) < 2 then 0 else coalesce(regr_slope(duration_ms, idx), 0) end trend_slope, arg_max(duration_ms, idx) latest_ms,
  list_sort(list(duration_ms))[n // 2 + 1] p50_ms, list_sort(list(duration_ms))[least(trunc(n * 0.95)::int, n - 1) + 1] p95_ms
  from h group by all)
"""


@query(
    f"""with {HISTORY},
z as (select *, case when sum(mean_ms) over w > 0 then mean_ms / sum(mean_ms) over w else 0 end share,
  case when std_ms > 0 and n >= 2 then least(greatest((latest_ms - mean_ms) / std_ms, 0), 5) else 0 end z from st window w as (partition by repository_id)),
sc as (select *, round_even(0.5 * share + 0.3 * z / 5 + case when trend_slope > 0 then 0.2 else 0 end, 4) score from z)
select repository_id, row_number() over (partition by repository_id order by score desc, step_name)::int rank_no, step_name, score, n,
  round_even(share * 100, 1) pct_of_total, round_even(mean_ms, 1) mean_ms, p50_ms, p95_ms, round_even(z, 2) anomaly,
  case when trend_slope > 10 then 'increasing' when trend_slope < -10 then 'decreasing' else 'stable' end trend, latest_ms
from sc qualify row_number() over (partition by repository_id order by score desc, step_name) <= 3"""
)
def bottleneck_ranking(spark: SparkSession, root: str) -> DataFrame:
    return timings.bottleneck_ranking(table(spark, root, "pipeline_runs"), table(spark, root, "step_timings"))


@query(f"with {HISTORY} select repository_id, step_name, n, round_even(mean_ms, 1) mean_ms, round_even(std_ms, 1) std_ms, round_even(trend_slope, 2) trend_slope, latest_ms, p50_ms, p95_ms from st")
def step_statistics(spark: SparkSession, root: str) -> DataFrame:
    s = timings.step_statistics(table(spark, root, "pipeline_runs"), table(spark, root, "step_timings"))
    return s.select("repository_id", "step_name", "n", F.bround("mean_ms", 1).alias("mean_ms"), F.bround("std_ms", 1).alias("std_ms"), F.bround("trend_slope", 2).alias("trend_slope"), "latest_ms", "p50_ms", "p95_ms")


@query("select repository_id, step_name, count(*) n, trunc(quantile_cont(duration_ms, 0.95))::bigint p95_ms from step_timings s join pipeline_runs r on r.id = s.pipeline_run_id where duration_ms is not null group by all")
def step_p95_interpolated(spark: SparkSession, root: str) -> DataFrame:
    """The exact interpolated percentile counts equal values map-side, so a step of any size sends its distinct values."""
    s = table(spark, root, "step_timings").select("pipeline_run_id", "step_name", "duration_ms").filter("duration_ms is not null")
    r = table(spark, root, "pipeline_runs").select(F.col("id").alias("pipeline_run_id"), "repository_id")
    return s.join(r, "pipeline_run_id").groupBy("repository_id", "step_name").agg(F.count(F.lit(1)).alias("n"), interpolated(F.col("duration_ms"), 0.95).cast("long").alias("p95_ms"))


@query("select pipeline_run_id, arg_max(step_name, (duration_ms, -id)) step_name, max(duration_ms) duration_ms, sum(duration_ms)::bigint total_ms from step_timings where duration_ms is not null group by 1")
def slowest_step_per_run(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "step_timings").filter("duration_ms is not null")
    return s.groupBy("pipeline_run_id").agg(F.max_by("step_name", F.struct("duration_ms", -F.col("id"))).alias("step_name"), F.max("duration_ms").alias("duration_ms"), F.sum("duration_ms").cast("long").alias("total_ms"))


@query("select id, repository_id, run_number, epoch_us(created_at) created_us from pipeline_runs order by created_at desc, id desc limit 20 offset 40")
def runs_page(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "pipeline_runs").orderBy(F.desc("created_at"), F.desc("id")).offset(40).limit(20)
    return r.select("id", "repository_id", "run_number", micros("created_at").alias("created_us"))


@query("select id, repository_id, epoch_us(created_at) created_us from pipeline_runs qualify row_number() over (partition by repository_id order by created_at desc, id desc) = 1")
def latest_run_per_repository(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "pipeline_runs").select("id", "repository_id", "created_at")
    w = Window.partitionBy("repository_id").orderBy(F.desc("created_at"), F.desc("id"))
    return r.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("id", "repository_id", micros("created_at").alias("created_us"))


@query(
    """select (select count(*) from tracked_repositories where is_active) repositories, (select count(*) from pipeline_runs) runs,
    (select round_even(avg(total_duration_ms), 1) from pipeline_runs where total_duration_ms is not null) avg_run_ms, (select count(*) from step_timings where status = 'failure') failed_steps"""
)
def dashboard_counts(spark: SparkSession, root: str) -> DataFrame:
    return spark.sql(
        """select (select count_if(is_active) from {repos}) as repositories, (select count(*) from {runs}) as runs,
        (select bround(avg(total_duration_ms), 1) from {runs}) as avg_run_ms, (select count_if(status = 'failure') from {steps}) as failed_steps""",
        repos=table(spark, root, "tracked_repositories"),
        runs=table(spark, root, "pipeline_runs"),
        steps=table(spark, root, "step_timings"),
    )


@query(
    """with k as (select * from app_function_calls where duration_ms is not null and session_id is not null
  qualify row_number() over (partition by session_id order by duration_ms desc, id) <= 50),
g as (select session_id, function_name, count(*) calls, sum(duration_ms)::bigint total_ms, max(duration_ms) max_ms, (sum(duration_ms) // count(*))::bigint avg_ms from k group by all),
p as (select *, case when sum(total_ms) over w > 0 then round_even(total_ms / sum(total_ms) over w * 100, 1) else 0 end pct,
  row_number() over (partition by session_id order by total_ms desc, function_name)::int rank_no from g window w as (partition by session_id))
select * from p where rank_no <= 10"""
)
def function_totals(spark: SparkSession, root: str) -> DataFrame:
    return timings.function_totals(table(spark, root, "app_function_calls"))


@query(
    """with o as (select * from app_function_calls qualify row_number() over (partition by session_id, function_name, call_number order by id) = 1)
select session_id, count(*) total_calls, coalesce(sum(duration_ms), 0)::bigint total_duration_ms, count(distinct function_name) functions from o group by 1"""
)
def session_totals(spark: SparkSession, root: str) -> DataFrame:
    """Totals per session without repeated deliveries; summed per function first, so a session of any size is pre-aggregated."""
    c = table(spark, root, "app_function_calls").select("session_id", "function_name", "call_number", "id", "duration_ms")
    once = c.groupBy("session_id", "function_name", "call_number").agg(F.min_by("duration_ms", "id").alias("d"))
    per = once.groupBy("session_id", "function_name").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d"))
    return per.groupBy("session_id").agg(F.sum("n").alias("total_calls"), F.coalesce(F.sum("d"), F.lit(0)).alias("total_duration_ms"), F.count("function_name").alias("functions"))


@query("select record_id, row_number() over (partition by session_id, func_name order by line_no, record_id)::bigint running_no from universal_log_records where session_id is not null and line_no is not null")
def call_numbering(spark: SparkSession, root: str) -> DataFrame:
    u = table(spark, root, "universal_log_records").select("record_id", "session_id", "func_name", "line_no").filter("session_id is not null and line_no is not null")
    u = u.withColumn("_c", F.floor(F.col("line_no") / CHUNK))
    return with_position(u, ["session_id", "func_name"], "_c", ["line_no", "record_id"], "running_no").select("record_id", "running_no")


@query(
    """with a as (select app_name, avg(total_duration_ms) a, count(*) sessions, avg(total_calls) c from app_log_sessions where status = 'completed' and total_duration_ms > 0 and app_name is not null group by 1)
select app_name, rank() over (order by a)::int rank_no, sessions, round_even(a, 1) avg_ms, round_even(c, 1) avg_calls,
  round_even(((rank() over (order by a) - 1) + 0.5 * count(*) over (partition by a)) / count(*) over () * 100, 0) percentile,
  round_even((select quantile_cont(a, 0.5) from a), 1) fleet_p50_ms, round_even((select quantile_cont(a, 0.9) from a), 1) fleet_p90_ms from a"""
)
def session_fleet(spark: SparkSession, root: str) -> DataFrame:
    return timings.session_fleet(table(spark, root, "app_log_sessions"))


@query(
    """with a as (select repository_id, avg(total_duration_ms) a, count(*) runs from pipeline_runs where total_duration_ms > 0 group by 1)
select repository_id, runs, round_even(a, 1) avg_ms, rank() over (order by a)::int rank_no, case when count(*) over () >= 2 then round_even(cume_dist() over (order by a) * 100, 1) end percentile from a"""
)
def pipeline_fleet(spark: SparkSession, root: str) -> DataFrame:
    return timings.pipeline_fleet(table(spark, root, "pipeline_runs"))


@query(
    """with c as (select f.id, session_id, app_name, function_name, duration_ms d from app_function_calls f join app_log_sessions s on s.id = f.session_id where duration_ms is not null and function_name is not null),
k as (select app_name, function_name, list_sort(list(d)) v from c group by all),
own as (select app_name, function_name, session_id, list_sort(list(d)) o from c group by all having max(d) >= 50),
v as (select app_name, function_name, d, count(*) n from c group by all),
b as (select o.app_name, o.function_name, o.session_id, len(k.v) - len(o.o) rest,
   (select min(x) from (select v.d x, sum(v.n - len(list_filter(o.o, lambda y: y = v.d))) over (order by v.d) u from v where v.app_name = o.app_name and v.function_name = o.function_name) q where u > (len(k.v) - len(o.o)) // 2) base
   from own o join k using (app_name, function_name)),
h as (select c.*, base from c join b using (app_name, function_name, session_id) where rest >= 3 and d >= 50 and base > 0 and d / base >= 1.5
   qualify row_number() over (partition by app_name, session_id, function_name order by id) = 1)
select session_id, app_name, function_name, id call_id, d current_ms, base::double baseline_ms, round_even(d / base, 2) ratio, case when d / base >= 2.5 then 'critical' else 'warning' end severity from h"""
)
def regression_alerts(spark: SparkSession, root: str) -> DataFrame:
    return timings.regressions(table(spark, root, "app_function_calls"), table(spark, root, "app_log_sessions"))


@query(
    """with r as (select id, repository_id from pipeline_runs qualify row_number() over (partition by repository_id order by created_at desc, id desc) <= 5)
select distinct repository_id, step_name from step_timings s join r on r.id = s.pipeline_run_id"""
)
def steps_of_last_runs(spark: SparkSession, root: str) -> DataFrame:
    w = Window.partitionBy("repository_id").orderBy(F.desc("created_at"), F.desc("id"))
    r = table(spark, root, "pipeline_runs").select("id", "repository_id", "created_at").withColumn("_r", F.row_number().over(w)).filter("_r <= 5")
    s = table(spark, root, "step_timings").select("step_name", F.col("pipeline_run_id").alias("id"))
    return s.join(r, "id").select("repository_id", "step_name").distinct()


@query("select id, repository_id from pipeline_runs r where not exists (select 1 from step_timings s where s.pipeline_run_id = r.id and s.status = 'failure')")
def runs_without_failures(spark: SparkSession, root: str) -> DataFrame:
    bad = table(spark, root, "step_timings").filter("status = 'failure'").select(F.col("pipeline_run_id").alias("id"))
    return table(spark, root, "pipeline_runs").select("id", "repository_id").join(bad, "id", "left_anti")


@query("select r.id, full_name, count(s.id) steps, count(s.annotation) noted from pipeline_runs r left join tracked_repositories t on t.id = r.repository_id left join step_timings s on s.pipeline_run_id = r.id group by all")
def run_details(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "pipeline_runs").select("id", "repository_id")
    t = table(spark, root, "tracked_repositories").select(F.col("id").alias("repository_id"), "full_name")
    s = table(spark, root, "step_timings").groupBy(F.col("pipeline_run_id").alias("id")).agg(F.count("id").alias("steps"), F.count("annotation").alias("noted"))
    return r.join(t, "repository_id", "left").join(s, "id", "left").select("id", "full_name", F.coalesce("steps", F.lit(0)).alias("steps"), F.coalesce("noted", F.lit(0)).alias("noted"))


@query("select lower(trim(step_name)) step, status, count(*) n, count(*) filter (where duration_ms is null) untimed, round_even(avg(duration_ms), 1) avg_ms from step_timings where status in ('success', 'failure') group by all having count(*) > 3")
def step_outcomes(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "step_timings").filter(F.col("status").isin("success", "failure"))
    g = s.groupBy(F.lower(F.trim("step_name")).alias("step"), "status")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("duration_ms").isNull()).alias("untimed"), F.bround(F.avg("duration_ms"), 1).alias("avg_ms")).filter("n > 3")


@query(
    "select app_name, function_name, count(*) calls, sum(duration_ms)::bigint total_ms, grouping_id(app_name, function_name)::int level from app_function_calls f join app_log_sessions s on s.id = f.session_id group by rollup (app_name, function_name)"
)
def call_rollup(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "app_log_sessions").select(F.col("id").alias("session_id"), "app_name")
    c = table(spark, root, "app_function_calls").groupBy("session_id", "function_name").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("d"))
    return c.join(s, "session_id").rollup("app_name", "function_name").agg(F.sum("n").alias("calls"), F.sum("d").alias("total_ms"), F.grouping_id().cast("int").alias("level"))


@query("select function_name from indexed_functions intersect select function_name from app_function_calls")
def functions_called(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "indexed_functions").select("function_name").intersect(table(spark, root, "app_function_calls").select("function_name"))


@query("select app_name, function_name from indexed_functions except select app_name, function_name from app_function_calls f join app_log_sessions s on s.id = f.session_id")
def functions_never_called(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "app_log_sessions").select(F.col("id").alias("session_id"), "app_name")
    c = table(spark, root, "app_function_calls").select("session_id", "function_name").distinct().join(s, "session_id").select("app_name", "function_name")
    return table(spark, root, "indexed_functions").select("app_name", "function_name").subtract(c)


# ---- names, units, index


@query(
    """select distinct function_name, lower(split_part(regexp_replace(trim(regexp_replace(function_name, '\\(.*\\)', '')), '^_+', ''), '.', -1)) bare from app_function_calls where function_name is not null"""
)
def normalised_names(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "app_function_calls").select("function_name").filter("function_name is not null").distinct()
    return c.select("function_name", bare_name(F.col("function_name")).alias("bare"))


@query(
    """with v as (select unnest(['1500', '0.25', '12.9', 'x', '']) v, 1 k), u as (select unnest(['ms', 's', 'us', 'ns', 'min', 'fortnight']) u, 1 k)
select v.v, u.u, case when try_cast(v as double) is null then 0 when u = 'ms' then trunc(v::double)::bigint when u = 's' then trunc(v::double * 1000)::bigint
  when u = 'us' then greatest(1, trunc(v::double / 1000)::bigint) when u = 'ns' then greatest(1, trunc(v::double / 1000000)::bigint) when u = 'min' then trunc(v::double * 60000)::bigint else trunc(v::double)::bigint end ms from v join u using (k)"""
)
def duration_units(spark: SparkSession, root: str) -> DataFrame:
    """A fixed table of values and units through the duration function."""
    rows = [(v, u) for v in ("1500", "0.25", "12.9", "x", "") for u in ("ms", "s", "us", "ns", "min", "fortnight")]
    return spark.createDataFrame(rows, "v string, u string").withColumn("ms", duration_ms(F.col("v"), F.col("u")))


BARE_SQL = "lower(split_part(regexp_replace(trim(regexp_replace({0}, '\\(.*\\)', '')), '^_+', ''), '.', -1))"
#: Names settled by the exact and the normalised stage; the looser stages compare spellings, which SQL can't.
SETTLED = f"""n as (select distinct app_name, name from ({{names}}) where app_name is not null and name is not null),
f as (select *, {BARE_SQL.format("function_name")} bare from indexed_functions),
m as (select n.app_name, n.name, coalesce(e.id, b.id) function_id, case when e.id is not null then 'exact' when b.id is not null then 'normalised' else 'looser or none' end stage
  from n left join f e on e.app_name = n.app_name and e.function_name = n.name
  left join f b on b.app_name = n.app_name and b.bare = {BARE_SQL.format("n.name")}
  qualify row_number() over (partition by n.app_name, n.name order by b.file_path, b.line_number, b.function_name) = 1)"""


@query(
    f"""with {SETTLED.format(names="select app_name, func_name as name from universal_log_records u join app_log_sessions s on s.id = u.session_id")}
select s.app_name, m.stage, count(*) records, count(distinct u.func_name) names from universal_log_records u join app_log_sessions s on s.id = u.session_id
join m on m.app_name = s.app_name and m.name = u.func_name group by all"""
)
def app_trace(spark: SparkSession, root: str) -> DataFrame:
    """Logged names of every session linked to the index: exact, normalised, fuzzy, then by tokens."""
    calls = table(spark, root, "universal_log_records").select("record_id", "session_id", F.col("func_name").alias("function_name"))
    out = linkage.match_calls(calls, table(spark, root, "app_log_sessions"), table(spark, root, "indexed_functions"))
    stage = F.when(F.col("match_method").isin("exact", "normalised"), F.col("match_method")).otherwise("looser or none")
    out = out.filter("app_name is not null and name is not null")
    return out.groupBy("app_name", stage.alias("stage")).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("name").alias("names"))


NAMES_SQL = SETTLED.format(names="select app_name, function_name as name from app_function_calls c join app_log_sessions s on s.id = c.session_id")


def _session_names(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "app_log_sessions").select(F.col("id").alias("session_id"), "app_name")
    return table(spark, root, "app_function_calls").select("session_id", F.col("function_name").alias("name")).distinct().join(s, "session_id").filter("app_name is not null and name is not null")


@query(f"with {NAMES_SQL} select app_name, name, stage, case when stage <> 'looser or none' then function_id end function_id, true as score_fits from m")
def name_matches(spark: SparkSession, root: str) -> DataFrame:
    """The function each name means where spelling settles it; where likeness does, whether the score is in its method's range."""
    out = linkage.match_names(_session_names(spark, root), table(spark, root, "indexed_functions"))
    sure = F.coalesce(F.col("match_method").isin("exact", "normalised"), F.lit(False))
    least = F.when(sure, 1.0).when(F.col("match_method") == "fuzzy", linkage.FUZZY).when(F.col("match_method") == "tokens", linkage.OVERLAP)
    fits = F.when(F.col("match_method").isNull(), F.col("function_id").isNull()).otherwise(F.col("match_score").between(least, 1.0))
    return out.select("app_name", "name", F.when(sure, F.col("match_method")).otherwise("looser or none").alias("stage"), F.when(sure, F.col("function_id")).alias("function_id"), fits.alias("score_fits"))


@query(
    f"""with {NAMES_SQL}, k as (select s.id, avg(case when m.stage <> 'looser or none' then 1.0 else 0.0 end) r
  from (select distinct session_id, function_name from app_function_calls) c join app_log_sessions s on s.id = c.session_id join m on m.app_name = s.app_name and m.name = c.function_name group by all)
select id as session_id, round_even(r, 3) match_rate from k"""
)
def match_rates(spark: SparkSession, root: str) -> DataFrame:
    """Share of a session's distinct names that the index knows by spelling."""
    names = _session_names(spark, root)
    out = names.join(linkage.match_names(names, table(spark, root, "indexed_functions")), ["app_name", "name"])
    known = F.when(F.col("match_method").isin("exact", "normalised"), 1.0).otherwise(0.0)
    return out.groupBy("session_id").agg(F.bround(F.avg(known), 3).alias("match_rate"))


@query(
    """with e as (select distinct f.app_name, f.function_name caller, c.callee from indexed_functions f, lateral (select unnest(from_json(calls_json, '["varchar"]')) callee) c
  where exists (select 1 from indexed_functions g where g.app_name = f.app_name and g.function_name = c.callee))
select * from e"""
)
def call_graph(spark: SparkSession, root: str) -> DataFrame:
    return linkage.call_edges(table(spark, root, "indexed_functions"))


@query(
    """with recursive e as (select distinct f.app_name, f.function_name caller, c.callee from indexed_functions f, lateral (select unnest(from_json(calls_json, '["varchar"]')) callee) c
  where exists (select 1 from indexed_functions g where g.app_name = f.app_name and g.function_name = c.callee)),
w as (select app_name, callee function_name, caller, 1 d from e union select w.app_name, w.function_name, e.caller, d + 1 from w join e on e.app_name = w.app_name and e.callee = w.caller where d < 5)
select app_name, function_name, caller, min(d)::int min_depth from w where caller <> function_name group by all"""
)
def callers_within_five(spark: SparkSession, root: str) -> DataFrame:
    return linkage.caller_closure(table(spark, root, "indexed_functions"))


@query(
    """with e as (select distinct f.app_name, f.function_name caller, c.callee from indexed_functions f, lateral (select unnest(from_json(calls_json, '["varchar"]')) callee) c
  where exists (select 1 from indexed_functions g where g.app_name = f.app_name and g.function_name = c.callee))
select app_name, callee, array_to_string(list_sort(list(caller))[:5], ',') callers, count(*) callers_n from e group by all"""
)
def direct_callers(spark: SparkSession, root: str) -> DataFrame:
    return linkage.direct_callers(table(spark, root, "indexed_functions"))


@query(
    """select c.id place_id, (select f.id from indexed_functions f where f.app_name = s.app_name and f.file_path = c.source_file and c.source_line between f.line_number and f.end_line_number order by f.line_number, f.id limit 1) function_id
from app_function_calls c join app_log_sessions s on s.id = c.session_id where c.source_line is not null"""
)
def enclosing_functions(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "app_log_sessions").select(F.col("id").alias("session_id"), "app_name")
    c = table(spark, root, "app_function_calls").filter("source_line is not null").select(F.col("id").alias("place_id"), "session_id", F.col("source_file").alias("file_path"), F.col("source_line").alias("line"))
    return linkage.enclosing_function(c.join(s, "session_id"), table(spark, root, "indexed_functions"))


@query(
    f"""with al as (select * from (values {", ".join(f"('{k}', '{v}')" for k, v in ALIASES.items())}) t(a, b)), both_ways as (select a, b from al union select b, a from al),
t as (select distinct app_name, function_name, g from (select app_name, function_name, unnest(regexp_split_to_array(regexp_replace(regexp_replace(lower(function_name), '^dissect_', ''), '^(diameter|gtpv2)_', ''), '[^a-z0-9]+')) g from indexed_functions) where length(g) > 1),
w as (select * from t union select app_name, function_name, b from t join both_ways on a = g),
n as (select app_name, function_name, count(*) k from w group by all),
c as (select x.app_name, x.function_name a, y.function_name b, count(*) m from w x join w y on x.app_name = y.app_name and x.g = y.g and x.function_name < y.function_name group by all)
select c.app_name, a, b, round_even(m / (p.k + q.k - m), 4) overlap from c join n p on p.app_name = c.app_name and p.function_name = a join n q on q.app_name = c.app_name and q.function_name = b"""
)
def token_overlaps(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of an app's functions that share a token, with the overlap of their token sets."""
    f = table(spark, root, "indexed_functions").select("app_name", "function_name", name_tokens(F.col("function_name")).alias("t"))
    a = f.select("app_name", F.col("function_name").alias("a"), F.col("t").alias("ta"), F.explode("t").alias("g"))
    b = f.select("app_name", F.col("function_name").alias("b"), F.col("t").alias("tb"), F.explode("t").alias("g"))
    met = a.join(b, ["app_name", "g"]).filter("a < b").select("app_name", "a", "b", "ta", "tb").distinct()
    return met.select("app_name", "a", "b", F.bround(token_overlap(F.col("ta"), F.col("tb")), 4).alias("overlap"))


# ---- log formats over all stored lines


def stored_lines(spark: SparkSession, root: str) -> DataFrame:
    """Stored lines, each place once, as ``file, line_no, line``."""
    r = table(spark, root, "raw_log_lines").filter("session_id is not null and line_no is not null")
    return r.groupBy(F.col("session_id").alias("file"), "line_no").agg(F.min_by("raw_line", "line_id").alias("line"))


LINES = "l as (select session_id file, line_no, raw_line line from raw_log_lines where session_id is not null and line_no is not null qualify row_number() over (partition by session_id, line_no order by line_id) = 1)"


def _re2(key: str) -> str:
    """A detection pattern for DuckDB: flags in its spelling, quotes doubled."""
    p = runtime_logs.DETECT[key]
    flags, rest = p[: p.index(")")], p[p.index(")") + 1 :].replace("'", "''")
    return ("(?i)" if "i" in flags else "") + rest


def _hits(key: str, most: int) -> str:
    return f"count(*) filter (where k <= {most} and regexp_matches(line, '{_re2(key)}')) / least(max(n), {most})"


FORMATS_SQL = f"""with {LINES}, s as (select file, line, line_no - min(line_no) over (partition by file) i from l where line is not null),
c as (select file, line, row_number() over (partition by file order by i) k, count(*) over (partition by file) n,
  case when regexp_matches(line, '{_re2("frame")}') then 2.0 when regexp_matches(line, '{_re2("elapsed")}') or regexp_matches(line, '{_re2("dissect")}') then 1.0
    when regexp_matches(line, '{_re2("tool")}') then 0.5 when regexp_matches(line, '{_re2("packet")}') then 0.35 else 0.0 end::double points
  from s where i < 100 and trim(line) <> ''),
sc as (select file, count(*) filter (where k <= 30 and trim(line) like '{{%' and json_valid(trim(line))) / least(max(n), 30) json,
  least({_hits("radcom", 40)} * 2.5, 1.0) radcom, {_hits("spring", 40)} spring, {_hits("rails", 40)} rails,
  least(coalesce(sum(points), 0) / least(max(n), 45) * 2.8, 1.0) tshark,
  count(*) filter (where k <= 30 and regexp_matches(line, '(?i)^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\s+(\\d{{1,2}})\\s+(\\d{{2}}:\\d{{2}}:\\d{{2}}(?:\\.\\d+)?)')) / least(max(n), 30) syslog,
  count(*) filter (where k <= 40 and regexp_matches(line, '{_re2("logfmt")}') and trim(line) not like '{{%') / least(max(n), 40) logfmt,
  case when count(*) filter (where k <= 50 and regexp_matches(line, '{_re2("enter")}')) > 0 and count(*) filter (where k <= 50 and regexp_matches(line, '{_re2("exit")}')) > 0 then 0.9 else 0.0 end enter_exit
  from c group by file),
b as (select *, greatest(json, radcom, spring, rails, tshark, syslog, logfmt, enter_exit) best from sc)"""


@query(
    FORMATS_SQL
    + f""" select file, case when best < 0.06 then 'heuristic' {" ".join(f"when {k} = best then '{k}'" for k in runtime_logs.FORMATS)} end log_format,
  round_even(case when best > 0.3 then best when best >= 0.06 then greatest(best, 0.12) when best = 0 then 0.25 else 0.18 end, 3) confidence from b"""
)
def detected_formats(spark: SparkSession, root: str) -> DataFrame:
    d = runtime_logs.detect_format(stored_lines(spark, root))
    return d.select("file", "log_format", F.bround("confidence", 3).alias("confidence"))


@query(
    f"""with {LINES}, m as (select file, line_no, regexp_extract(line, '(?i)D:(\\d{{4}}-\\d{{2}}-\\d{{2}}[\\s]\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d+).*?\\bFN:([A-Za-z_$][A-Za-z0-9_$<>]+)', ['t', 'f']) g,
  regexp_extract(line, '(?i)(?:completed?|initializ|started?|took|elapsed|finished?|done)\\w*\\s+(?:in\\s+)?([\\d.]+)\\s*(ms|s|sec)\\b', ['v', 'u']) d from l),
e as (select file, line_no, g.f f, epoch_us(g.t::timestamp) t, case when d.v <> '' then trunc(try_cast(d.v as double) * case when lower(d.u) = 'ms' then 1 else 1000 end)::bigint end ms from m
  where g.f <> '' and g.f not in ('log','info','warn','error','debug','trace','isReady','run','main','start')),
n as (select *, lag(ms is null) over w pp, lag(t) over w pt from e window w as (partition by file, f order by line_no)),
c as (select file, line_no, f, case when ms is not null then case when ms > 0 then ms end when pp and (t - pt) // 1000 between 1 and 60000 then (t - pt) // 1000 end d, case when ms is null then pt else t end ts from n)
select file, line_no, f func_name, row_number() over (partition by file, f order by line_no)::bigint call_number, d::bigint duration_ms, ts timestamp_us from c where d is not null"""
)
def tagged_calls(spark: SparkSession, root: str) -> DataFrame:
    """Calls of the tagged format (explicit durations and distances), without the plain fallback for other files."""
    lines = stored_lines(spark, root)
    tagged = lines.join(lines.filter(F.col("line").rlike(runtime_logs.TAGGED_LINE)).select("file").distinct(), "file", "left_semi")
    out = runtime_logs.parse_tagged(tagged)
    explicit = out.join(lines.select("file", "line_no", "line"), ["file", "line_no"]).filter(F.col("line").rlike(runtime_logs.TAGGED_LINE))
    return explicit.select("file", "line_no", "func_name", "call_number", "duration_ms", "timestamp_us")


PLAIN_SQL = f"""with {LINES}, m as (select file, line_no, line,
  regexp_extract(line, '(?i)\\b([a-z_]\\w{{2,}})\\s+(?:took|elapsed|duration|latency|time|finished in|completed in)[\\s:=]*([\\d.]+)\\s*(ms|s|sec|us|μs|ns|m(?:in)?)\\b', ['f', 'v', 'u']) a,
  regexp_extract(line, '(?i)\\b([a-z_]\\w{{2,}}):\\s*([\\d.]+)\\s*(ms|s|sec|us|μs|ns)\\b', ['f', 'v', 'u']) b,
  regexp_extract(line, '(?i)(?:took|elapsed|duration|completed in|finished in|latency)[\\s:=]*([\\d.]+)\\s*(ms|s|sec|us|μs|ns|m(?:in)?)\\b[^a-z_]*([a-z_]\\w{{2,}})\\b', ['v', 'u', 'f']) c from l),
p as (select file, line_no, case when a.f <> '' then a.f when b.f <> '' then b.f else c.f end f, case when a.f <> '' then a.v when b.f <> '' then b.v else c.v end v,
  lower(case when a.f <> '' then a.u when b.f <> '' then b.u else c.u end) u from m),
d as (select file, line_no, f, case when try_cast(v as double) is null then 0 when u = 'ms' then trunc(v::double) when u in ('s', 'sec') then trunc(v::double * 1000) when u in ('us', 'μs') then greatest(1, trunc(v::double / 1000))
  when u = 'ns' then greatest(1, trunc(v::double / 1000000)) else trunc(v::double * 60000) end::bigint ms from p
  where f <> '' and lower(f) not in ('the','in','at','by','on','for','to','and','not','with','from','into','done','took','elapsed','duration','time','latency','sec','second','seconds','minute','total','http','api') and not regexp_full_match(f, '\\d+|[vV]\\d+'))
select file, line_no, f func_name, row_number() over (partition by file, f order by line_no)::bigint call_number, ms duration_ms from d"""


@query(PLAIN_SQL)
def plain_calls(spark: SparkSession, root: str) -> DataFrame:
    return runtime_logs.parse_heuristic(stored_lines(spark, root)).select("file", "line_no", "func_name", "call_number", "duration_ms")


@query(f"with {LINES} select count(distinct file) as files, true as numbered, true as named, true as timed from l")
def parsed_calls(spark: SparkSession, root: str) -> DataFrame:
    """All stored files, each by the parser of its named or detected format: are a function's calls numbered 1 to n, named in their line and of no negative time?"""
    named = table(spark, root, "app_log_sessions").select(F.col("id").alias("file"), "log_format")
    lines = stored_lines(spark, root)
    calls = stored(runtime_logs.parse_lines(lines, named), "parsed-calls")
    each = calls.groupBy("file", "func_name").agg(F.count(F.lit(1)).alias("n"), F.max("call_number").alias("m"), F.count_distinct("call_number").alias("d"))
    fits = calls.select((F.col("duration_ms") >= 0).alias("timed"), F.col("raw_line").contains(F.element_at(F.split("func_name", ":"), 1)).alias("named"))
    return spark.sql(
        """select (select count(distinct file) from {lines}) as files, (select bool_and(n = m and n = d) from {each}) as numbered,
        (select bool_and(named) from {fits}) as named, (select bool_and(timed) from {fits}) as timed""",
        lines=lines, each=each, fits=fits,
    )


@query(
    f"""with {LINES}, m as (select file, line_no, regexp_extract(line, '(?i)(\\w+)\\s+took\\s+([\\d.]+)(ms|s)', ['f', 'v', 'u']) g from l)
select file, line_no, g.f func_name, row_number() over (partition by file, g.f order by line_no)::bigint call_number,
  case when try_cast(g.v as double) is null then 0 when lower(g.u) = 's' then trunc(g.v::double * 1000) else trunc(g.v::double) end::bigint duration_ms, null::bigint timestamp_us from m where g.f <> ''"""
)
def custom_calls(spark: SparkSession, root: str) -> DataFrame:
    return runtime_logs.parse_custom(stored_lines(spark, root), r"(?P<func>\w+)\s+took\s+(?P<duration>[\d.]+)(?P<unit>ms|s)").drop("raw_line")


@query(
    f"""with {LINES}, h as (select file, line_no from l where line like '%replayed entry%')
select h.file, h.line_no, substring(string_agg(rtrim(l.line, ' '), chr(10) order by l.line_no), 1, 2000) log_excerpt from h join l on l.file = h.file and l.line_no between h.line_no - 2 and h.line_no + 2 group by all"""
)
def line_context(spark: SparkSession, root: str) -> DataFrame:
    lines = stored_lines(spark, root)
    return runtime_logs.with_excerpt(lines.filter(F.col("line").contains("replayed entry")).select("file", "line_no"), lines, 2, 2)


CI_SQL = f"""with {LINES}, p as (select file, line_no, regexp_extract(regexp_replace(line, '\\s+$', ''), '^(\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d+Z)\\s+(.*)$', ['t', 'm']) g from l),
r as (select file, line_no, epoch_us(g.t::timestamptz) ts, g.m raw, regexp_extract(g.m, '^##\\[(group|endgroup|error|warning)\\](.*)$', ['k', 'm']) a from p where g.t <> ''),
e as (select *, a.k = 'endgroup' is_end, row_number() over (partition by file order by line_no) n from r),
d as (select *, n - coalesce(max(case when not is_end then n end) over (partition by file order by line_no), 0) place, max(case when not is_end then n end) over (partition by file order by line_no) is null lead_in from e),
c as (select *, is_end and (place % 2 = case when lead_in then 0 else 1 end) closes from d),
b as (select *, a.k = 'group' opens, a.k = 'group' or coalesce(lag(closes) over (partition by file order by line_no), true) begins from c),
x as (select *, sum(begins::int) over (partition by file order by line_no)::bigint section_no from b),
y as (select file, section_no, min(line_no) first_line_no, max(line_no) last_line_no, count(*) lines, min(ts) started_us, max(ts) ended_us, (max(ts) - min(ts)) // 1000 duration_ms,
  case when count(*) filter (where a.k = 'error' and not begins) > 0 then 'failure' else 'success' end status, arg_max(a.k, line_no) filter (where a.k in ('error', 'warning') and not begins) annotation,
  bool_or(opens) grouped, arg_min(trim(a.m), line_no) filter (where a.k = 'group') title, string_agg(raw, chr(10) order by line_no) t from x group by all)"""


@query(
    CI_SQL
    + """ select file, section_no, first_line_no, last_line_no, lines, started_us, ended_us, duration_ms, status, annotation,
  case when not grouped then 'Setup' when title = '' then 'Step ' || section_no else title end step_name, case when grouped then section_no else 0 end::int step_number,
  case when length(t) <= 2000 then t else left(t, 1000) || chr(10) || '... [truncated] ...' || chr(10) || right(t, 1000) end log_excerpt from y"""
)
def ci_steps(spark: SparkSession, root: str) -> DataFrame:
    """CI logs among the stored files rolled up into steps."""
    return flat_steps(stored_lines(spark, root))


# ---- texts


@query(
    """select file_path, count(*) functions, case when regexp_matches(lower(file_path), '\\.(jsx|tsx|vue|css|scss|less|svelte)$') then 'frontend' when regexp_matches(lower(file_path), '\\.env|id_rsa|\\.pem|secrets/|secret_|/oauth|/auth/|csrf|xss|jwt|password|api_key|apikey|credential') then 'security'
 when regexp_matches(lower(file_path), '\\.(sql|prisma)$|migration|alembic|prisma|/models/|schema\\.sql|knex|sequelize|drizzle|typeorm|querybuilder|db/|database/') then 'database'
 when regexp_matches(lower(file_path), 'dockerfile|docker-compose|\\.github/workflows|kubernetes|\\.tf|terraform|helm/|nginx\\.conf|k8s/') then 'infrastructure'
 when regexp_matches(lower(file_path), '/frontend/|/web/|/ui/|/client/|/static/|/components/|src/pages/|src/app/|/views/') then 'frontend' else 'backend' end as file_domain from indexed_functions group by all"""
)
def file_domains(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "indexed_functions").groupBy("file_path").agg(F.count(F.lit(1)).alias("functions"))
    return f.withColumn("file_domain", classify_domain(F.col("file_path")))


#: Constructs appended to the documents, so that the rules have something to find.
RISKY = ("eval (x)", "pickle.loads(b) api_key = 'k'", "yaml.load(f)")
SIGNAL_VALUES = ", ".join("('(?is){}', '{}')".format(p.replace("'", "''"), label) for p, label in SIGNALS if "(?!" not in p)


@query(
    "with d as (select text || case doc_id % 3 {} end t from documents where text is not null and doc_id is not null)".format(" ".join("when {} then '{}'".format(i, x.replace("'", "''")) for i, x in enumerate(RISKY)))
    + f""" select signal, count(*) documents from d, (values {SIGNAL_VALUES}) v(p, signal) where regexp_matches(t, p) group by 1
union all select 'unsafe yaml.load', count(*) from d where regexp_matches(t, '(?is)yaml\\.load\\s*\\([^)]*\\)') having count(*) > 0"""
)
def text_signals(spark: SparkSession, root: str) -> DataFrame:
    """Risky constructs by label, in documents that each got one appended."""
    d = table(spark, root, "documents").filter("text is not null and doc_id is not null")
    more = F.element_at(F.array(*[F.lit(x) for x in RISKY]), (F.col("doc_id") % 3 + 1).cast("int"))
    d = d.select(F.explode(security_signals(F.concat("text", more))).alias("signal"))
    return d.groupBy("signal").agg(F.count(F.lit(1)).alias("documents"))


@query("select id, sha256(file_path || ':' || line_number || ':' || function_name) op_id from indexed_functions")
def stable_ids(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "indexed_functions").select("id", stable_id("file_path", "line_number", "function_name").alias("op_id"))


@query(
    """with r as (select id, repository_id, run_number::double x, total_duration_ms::double y from pipeline_runs where total_duration_ms is not null and run_number is not null),
f as (select regr_slope(y, x) b, avg(y) my, avg(x) mx, sqrt(var_pop(y) - regr_slope(y, x) ^ 2 * var_pop(x)) s from r)
select id from r, f where abs(y - (my - b * mx) - b * x) > 3 * s"""
)
def run_time_anomalies(spark: SparkSession, root: str) -> DataFrame:
    """Runs far off the line of duration on run number."""
    r = table(spark, root, "pipeline_runs").select("id", F.col("run_number").cast("double").alias("x"), F.col("total_duration_ms").cast("double").alias("y"))
    return timings.line_model(r, "x", "y").filter("is_anomaly").select("id")


# ---- events, batch twins of the streaming plans


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) n, round_even(sum(value), 4) total from events group by all")
def events_hourly(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    g = e.groupBy(F.window(F.col("ts"), "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.bround(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query(
    """with e as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minutes or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end b from events),
s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from e)
select user_id, epoch_us(min(ts)) from_us, epoch_us(max(ts)) + 1800000000 to_us, count(*) n from s group by user_id, k"""
)
def events_sessions(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    g = e.groupBy("user_id", F.session_window(F.col("ts"), "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", micros(F.col("w.start")).alias("from_us"), micros(F.col("w.end")).alias("to_us"), "n")


# ---- further aggregates and windows


@query(
    """with e as (select app_name, unnest(from_json(calls_json, '["varchar"]')) callee from indexed_functions),
c as (select app_name, callee, count(*) n from e where trim(callee) <> '' group by all)
select app_name, callee, n from c qualify row_number() over (partition by app_name order by n desc, callee) = 1"""
)
def most_called_function(spark: SparkSession, root: str) -> DataFrame:
    """Mode of the items of a JSON list per app, ties by name."""
    e = table(spark, root, "indexed_functions").select("app_name", F.explode(F.from_json("calls_json", "array<string>")).alias("callee"))
    c = e.filter(F.trim("callee") != "").groupBy("app_name", "callee").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("app_name").orderBy(F.desc("n"), "callee")
    return c.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


@query(
    """select app_name, count(*) functions, count(*) filter (where list_contains(from_json(calls_json, '["varchar"]'), function_name)) calls_itself, count(*) filter (where calls_json is null) leaves from indexed_functions group by 1"""
)
def call_lists(spark: SparkSession, root: str) -> DataFrame:
    """Membership in JSON lists, counted per app."""
    f = table(spark, root, "indexed_functions").withColumn("c", F.from_json("calls_json", "array<string>"))
    itself = F.coalesce(F.array_contains("c", F.col("function_name")), F.lit(False))
    return f.groupBy("app_name").agg(F.count(F.lit(1)).alias("functions"), F.count_if(itself).alias("calls_itself"), F.count_if(F.col("calls_json").isNull()).alias("leaves"))


@query(
    """with f as (select session_id, func_name, min(line_no) first_line from universal_log_records where line_no is not null group by all)
select *, dense_rank() over (partition by session_id order by first_line)::int place from f"""
)
def first_seen_order(spark: SparkSession, root: str) -> DataFrame:
    """Functions of a session in the order of their first line; ranked after grouping, over distinct names."""
    u = table(spark, root, "universal_log_records").filter("line_no is not null").groupBy("session_id", "func_name").agg(F.min("line_no").alias("first_line"))
    return u.withColumn("place", F.dense_rank().over(Window.partitionBy("session_id").orderBy("first_line")).cast("int"))


@query(
    "select id step_id, round_even(duration_ms / sum(duration_ms) over (partition by pipeline_run_id) * 100, 3) pct from step_timings where duration_ms > 0 qualify sum(duration_ms) over (partition by pipeline_run_id) > 0"
)
def step_shares(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "step_timings").select("id", "pipeline_run_id", "duration_ms").filter("duration_ms > 0")
    total = s.groupBy("pipeline_run_id").agg(F.sum("duration_ms").alias("_t"))
    return s.join(total, "pipeline_run_id").select(F.col("id").alias("step_id"), F.bround(F.col("duration_ms") / F.col("_t") * 100, 3).alias("pct"))


@query(
    """select id, round_even(avg(total_duration_ms) over w, 1) moving_ms, count(total_duration_ms) over w n from pipeline_runs window w as (partition by repository_id order by created_at, id rows between 4 preceding and current row)"""
)
def moving_run_time(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "pipeline_runs").select("id", "repository_id", "total_duration_ms", "created_at", F.floor(micros("created_at") / DAY_US).alias("_c"))
    r = with_position(r, ["repository_id"], "_c", ["created_at", "id"], "_p").drop("_c")
    # Blocks of positions, each with the four rows before it, so that a repository of any size is split.
    home = F.floor(F.col("_p") / CHUNK)
    r = r.withColumn("_home", home).withColumn("_b", F.explode(F.array_distinct(F.array(home, F.floor((F.col("_p") + 4) / CHUNK)))))
    w = Window.partitionBy("repository_id", "_b").orderBy("_p").rowsBetween(-4, 0)
    r = r.select("id", "_home", "_b", F.bround(F.avg("total_duration_ms").over(w), 1).alias("moving_ms"), F.count("total_duration_ms").over(w).alias("n"))
    return r.filter("_home = _b").drop("_home", "_b")


@query("select id, repository_id, total_duration_ms from pipeline_runs where total_duration_ms is not null order by total_duration_ms desc, id limit 10")
def longest_runs(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "pipeline_runs").filter("total_duration_ms is not null")
    return r.orderBy(F.desc("total_duration_ms"), "id").limit(10).select("id", "repository_id", "total_duration_ms")


@query("select event_type, count(*) n, sum(try_cast(json_extract_string(props, '$.k') as bigint))::bigint total_k from events group by 1")
def event_properties(spark: SparkSession, root: str) -> DataFrame:
    """A field of JSON text, unreadable text counting as nothing."""
    e = table(spark, root, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total_k"))


@query(
    """with r as (select repository_id, run_number, created_at, id, lag(conclusion) over (partition by repository_id order by created_at, id) before, conclusion from pipeline_runs)
select id, repository_id, conclusion from r where conclusion = 'failure' and before = 'success'"""
)
def newly_failing_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs that fail right after one that succeeded."""
    r = table(spark, root, "pipeline_runs").select("id", "repository_id", "conclusion", "created_at", F.floor(micros("created_at") / DAY_US).alias("_c"))
    r = with_neighbour(r, ["repository_id"], "_c", ["created_at", "id"], {"_b": "conclusion"})
    return r.filter("conclusion = 'failure' and _b = 'success'").select("id", "repository_id", "conclusion")


@query(
    """with s as (select log_excerpt e from step_timings where log_excerpt is not null)
select count(*) texts, count(distinct e) different, sum(length(trim(regexp_replace(regexp_replace(e, '^\\d{4}-\\d{2}-\\d{2}T[\\d:.]+Z\\s*', ''), '##\\[\\w+\\]', '', 'g'), ' ')))::bigint clean_chars from s"""
)
def clean_excerpts(spark: SparkSession, root: str) -> DataFrame:
    """Excerpts without times and marks: how many, how different, how long."""
    e = table(spark, root, "step_timings").select("log_excerpt").filter("log_excerpt is not null")
    return e.agg(F.count(F.lit(1)).alias("texts"), F.count_distinct("log_excerpt").alias("different"), F.sum(F.length(clean_line(F.col("log_excerpt")))).alias("clean_chars"))


@query("select app_name, code_language, count(*) functions, count(distinct file_path) files, sum(end_line_number - line_number + 1)::bigint code_lines from indexed_functions group by all")
def code_languages(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "indexed_functions").groupBy("app_name", "code_language")
    return f.agg(F.count(F.lit(1)).alias("functions"), F.count_distinct("file_path").alias("files"), F.sum(F.col("end_line_number") - F.col("line_number") + 1).alias("code_lines"))


@query(
    """select session_id, count(*) records, count(*) filter (where length(log_excerpt) > 200) cut, max(length(substring(log_excerpt, 1, 200))) longest from universal_log_records group by 1"""
)
def excerpt_sizes(spark: SparkSession, root: str) -> DataFrame:
    u = table(spark, root, "universal_log_records").groupBy("session_id")
    return u.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.length("log_excerpt") > 200).alias("cut"), F.max(F.length(F.substring("log_excerpt", 1, 200))).cast("long").alias("longest"))


@query("select true as few, true as short, true as first")
def log_previews(spark: SparkSession, root: str) -> DataFrame:
    """Format and first records of every stored file: at most five each, lines of at most 200 characters, none left out before them."""
    lines = stored_lines(spark, root)
    each = runtime_logs.preview(lines).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("upto"), F.max(F.length("raw_line")).alias("longest"))
    before = runtime_logs.parse_lines(lines).join(each.select("file", "upto"), "file").filter(F.col("line_no") < F.col("upto")).groupBy("file").agg(F.count(F.lit(1)).alias("before"))
    both = each.join(before, "file", "left").fillna(0, ["before"])
    return both.agg(F.bool_and(F.col("n") <= 5).alias("few"), F.bool_and(F.col("longest") <= 200).alias("short"), F.bool_and(F.col("before") < F.col("n")).alias("first"))
