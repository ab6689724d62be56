"""Further queries of the analytics engine: ingestion, look-ups, formatting and domain statistics, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latchline.functions import display
from latchline.operators import codeindex, flows, ingest, linkage
from latchline.operators.ordered import with_position
from latchline.operators.text_rules import classify_domain, issue_domain
from latchline.plans.reference import LINES, stored_lines
from latchline.tables import micros, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOUR_US = 3_600_000_000


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(
    """with k as (select repository_id, run_number from pipeline_runs where run_number % 2 = 0)
select min(id) id, repository_id, run_number from pipeline_runs r where repository_id in (select id from tracked_repositories) and run_number is not null
  and not exists (select 1 from k where k.repository_id = r.repository_id and k.run_number = r.run_number) group by 2, 3"""
)
def runs_to_ingest(spark: SparkSession, root: str) -> DataFrame:
    """Runs that are new where every second number is known already."""
    runs = table(spark, root, "pipeline_runs")
    return ingest.new_runs(runs, runs.filter("run_number % 2 = 0"), table(spark, root, "tracked_repositories")).select("id", "repository_id", "run_number")


@query(
    """select pipeline_run_id, count(*) steps, sum(coalesce(duration_ms, 0))::bigint total_ms, arg_max(step_name, (coalesce(duration_ms, 0), -id)) slowest_step, max(coalesce(duration_ms, 0)) slowest_ms
from step_timings where pipeline_run_id is not null group by 1"""
)
def run_summaries(spark: SparkSession, root: str) -> DataFrame:
    return ingest.run_summaries(table(spark, root, "step_timings"))


@query("select id, length(substring(repeat(coalesce(log_excerpt, '-'), 60), 1, 2000)) kept from app_function_calls")
def stored_excerpts(spark: SparkSession, root: str) -> DataFrame:
    """Calls with long excerpts as they would be stored."""
    calls = table(spark, root, "app_function_calls").select("id", F.repeat(F.coalesce("log_excerpt", F.lit("-")), F.lit(60)).alias("log_excerpt"))
    return ingest.stored_calls(calls).select("id", F.length("log_excerpt").cast("long").alias("kept"))


@query(
    """with c as (select app_name, custom_pattern, count(*) used from app_log_sessions where app_name is not null and trim(custom_pattern) <> '' group by all)
select app_name, custom_pattern, used from c qualify row_number() over (partition by app_name order by used desc, custom_pattern) = 1"""
)
def best_patterns(spark: SparkSession, root: str) -> DataFrame:
    return ingest.best_patterns(table(spark, root, "app_log_sessions"))


@query("select id, exists (select 1 from pipeline_runs r where r.repository_id = t.id) has_runs, exists (select 1 from app_log_sessions s where s.source_repo = t.full_name) has_logs from tracked_repositories t")
def repository_look_ups(spark: SparkSession, root: str) -> DataFrame:
    """Existence per repository, by key."""
    t = table(spark, root, "tracked_repositories").select("id", "full_name")
    r = table(spark, root, "pipeline_runs").select(F.col("repository_id").alias("id"), F.lit(True).alias("_r")).distinct()
    s = table(spark, root, "app_log_sessions").select(F.col("source_repo").alias("full_name"), F.lit(True).alias("_s")).distinct()
    return t.join(r, "id", "left").join(s, "full_name", "left").select("id", F.coalesce("_r", F.lit(False)).alias("has_runs"), F.coalesce("_s", F.lit(False)).alias("has_logs"))


@query(
    """with o as (select id, repository_id, conclusion, row_number() over (partition by repository_id order by created_at desc, id desc) n from pipeline_runs),
k as (select *, row_number() over (partition by repository_id order by n) place from o where n <= 20 and conclusion in ('success', 'failure', 'cancelled'))
select id, repository_id, conclusion, place::int place from k where place <= 5"""
)
def concluded_runs(spark: SparkSession, root: str, most: int = 5) -> DataFrame:
    """The newest runs of each repository with a conclusion that counts, found among four times as many."""
    newest = Window.partitionBy("repository_id").orderBy(F.desc("created_at"), F.desc("id"))
    r = table(spark, root, "pipeline_runs").select("id", "repository_id", "conclusion", "created_at")
    over = r.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= 4 * most).filter(F.col("conclusion").isin("success", "failure", "cancelled"))
    return over.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= most).select("id", "repository_id", "conclusion", "place")


@query(
    """select id, repository_id, (select count(*) from pipeline_runs) total_runs, ceil((select count(*) from pipeline_runs) / 20.0)::bigint pages
from pipeline_runs order by created_at desc, id desc limit 20 offset 20"""
)
def runs_page_of(spark: SparkSession, root: str, page: int = 2, size: int = 20) -> DataFrame:
    """A page of runs, newest first, with the number of all runs and pages."""
    r = table(spark, root, "pipeline_runs").select("id", "repository_id", "created_at")
    p = r.orderBy(F.desc("created_at"), F.desc("id")).offset((max(1, page) - 1) * size).limit(min(size, 100))
    return spark.sql(
        f"select id, repository_id, (select count(*) from {{r}}) as total_runs, cast(ceil((select count(*) from {{r}}) / {float(size)}) as bigint) as pages from {{p}}", r=r, p=p
    )


@query("select id, row_number() over (order by started_at, id)::bigint seq from app_function_calls where started_at is not null")
def call_sequence(spark: SparkSession, root: str) -> DataFrame:
    """Place of each call among all calls by time, numbered hour by hour so that no task sorts them all."""
    c = table(spark, root, "app_function_calls").select("id", micros("started_at").alias("_t")).filter("_t is not null")
    c = c.withColumn("_all", F.lit(0)).withColumn("_c", F.floor(F.col("_t") / HOUR_US))
    return with_position(c, ["_all"], "_c", ["_t", "id"], "seq").select("id", "seq")


@query(
    """with done as (select * from pipeline_runs where status = 'completed'),
same as (select r.id, arg_max(d.id, (d.created_at, d.id)) b from pipeline_runs r join done d on d.repository_id = r.repository_id and d.head_sha = r.head_sha group by 1),
latest as (select repository_id, arg_max(id, (created_at, id)) b from done group by 1)
select r.id, coalesce(same.b, latest.b) base_id from pipeline_runs r left join same on same.id = r.id left join latest on latest.repository_id = r.repository_id"""
)
def base_runs(spark: SparkSession, root: str) -> DataFrame:
    """For each run the completed one of the same commit, else the repository's latest completed one."""
    r = table(spark, root, "pipeline_runs").select("id", "repository_id", "head_sha", "status", "created_at")
    newest = lambda name: F.max_by("id", F.struct("created_at", "id")).alias(name)
    done = r.filter("status = 'completed'")
    same, latest = done.groupBy("repository_id", "head_sha").agg(newest("_same")), done.groupBy("repository_id").agg(newest("_latest"))
    return r.join(same, ["repository_id", "head_sha"], "left").join(latest, "repository_id", "left").select("id", F.coalesce("_same", "_latest").alias("base_id"))


@query(
    """with s as (select distinct step_name, regexp_replace(lower(step_name), '^(run |step |execute )+', '') t from step_timings where step_name is not null),
f as (select s.step_name, min(i.id) id from s join indexed_functions i on length(t) >= 3 and contains(lower(i.function_name), t) group by 1),
p as (select s.step_name, min(i.id) id from s join indexed_functions i on length(t) >= 3 and contains(lower(i.file_path), t) group by 1)
select s.step_name, coalesce(f.id, p.id) function_id, case when f.id is not null then 0.5 when p.id is not null then 0.3 end::double confidence from s left join f using (step_name) left join p using (step_name)"""
)
def step_sources(spark: SparkSession, root: str) -> DataFrame:
    """Step names linked to a function whose name, or whose file's path, holds them."""
    return linkage.step_matches(table(spark, root, "step_timings").select("step_name"), table(spark, root, "indexed_functions"))


@query(
    f"""with {LINES}, t as (select file, line_no, regexp_extract(line, '(?:^|\\s)C:(\\S+)', 1) c from l where regexp_matches(line, '\\bF[Nn]:'))
select c as component, count(*) as lines from t where c <> '' and c <> 'System' and not contains(lower(c), 'metrics') group by 1"""
)
def component_lines(spark: SparkSession, root: str) -> DataFrame:
    """Tagged lines by component, those of the system and of metrics left out."""
    lines = stored_lines(spark, root).filter(F.col("line").rlike(r"\bF[Nn]:"))
    c = lines.select(F.regexp_extract("line", r"(?:^|\s)C:(\S+)", 1).alias("component"))
    return flows.counted_components(c, "component").groupBy("component").agg(F.count(F.lit(1)).alias("lines"))


@query(
    """select id, case when duration_ms >= 1000 then ((duration_ms + 50) // 100 // 10) || '.' || ((duration_ms + 50) // 100 % 10) || 's' when duration_ms is null then '-' else duration_ms || 'ms' end short,
  case when duration_ms is null then '-' when duration_ms < 0 then '-' else
    case when (duration_ms + 500) // 1000 >= 3600 then ((duration_ms + 500) // 1000 // 3600) || 'h ' else '' end || case when (duration_ms + 500) // 1000 >= 60 then ((duration_ms + 500) // 1000 % 3600 // 60) || 'm ' else '' end || ((duration_ms + 500) // 1000 % 60) || 's' end long,
  case when duration_ms > 60000 then 'red' when duration_ms > 5000 then 'amber' else 'green' end color,
  case when duration_ms >= 0 then round_even(duration_ms / greatest(duration_ms, 15000) * 100, 2) end width_pct from step_timings where duration_ms < 100000000 or duration_ms is null"""
)
def shown_steps(spark: SparkSession, root: str) -> DataFrame:
    """Durations as they are shown: short and long text, colour and width of a bar."""
    s = table(spark, root, "step_timings").filter("duration_ms < 100000000 or duration_ms is null")
    ms = F.col("duration_ms")
    width: Column = F.when(ms >= 0, F.bround(display.bar_percent(ms, F.lit(15000)), 2))
    return s.select("id", display.short_ms(ms).alias("short"), display.long_ms(ms).alias("long"), display.bar_color(ms, F.lit(5000), F.lit(60000)).alias("color"), width.alias("width_pct"))


@query(
    """with p as (select unnest(['GET /data/packets/a1/list', 'x /data/t9/iograph, then /data/packets/q/seq.', '/data/closeTrace', 'nothing', '/data/a/b/c', '/data/']) line)
select line, case line when 'GET /data/packets/a1/list' then 'packet-related' when 'x /data/t9/iograph, then /data/packets/q/seq.' then 'packet-related' when '/data/closeTrace' then 'no-trace' when '/data/a/b/c' then 'console-function' end kind,
  case line when 'GET /data/packets/a1/list' then 'list' when 'x /data/t9/iograph, then /data/packets/q/seq.' then 'seq' when '/data/closeTrace' then 'closeTrace' when '/data/a/b/c' then 'b' end func from p"""
)
def request_kinds(spark: SparkSession, root: str) -> DataFrame:
    """A fixed table of request lines: kind and function of the last path in each."""
    rows = [(x,) for x in ("GET /data/packets/a1/list", "x /data/t9/iograph, then /data/packets/q/seq.", "/data/closeTrace", "nothing", "/data/a/b/c", "/data/")]
    kind, func = flows.last_request(F.col("line"))
    return spark.createDataFrame(rows, "line string").select("line", kind.alias("kind"), func.alias("func"))


DOMAIN_SQL = """case when regexp_matches(lower(file_path), '\\.(jsx|tsx|vue|css|scss|less|svelte)$') then 'frontend' when regexp_matches(lower(file_path), '\\.env|id_rsa|\\.pem|secrets/|secret_|/oauth|/auth/|csrf|xss|jwt|password|api_key|apikey|credential') then 'security'
 when regexp_matches(lower(file_path), '\\.(sql|prisma)$|migration|alembic|prisma|/models/|schema\\.sql|knex|sequelize|drizzle|typeorm|querybuilder|db/|database/') then 'database'
 when regexp_matches(lower(file_path), 'dockerfile|docker-compose|\\.github/workflows|kubernetes|\\.tf|terraform|helm/|nginx\\.conf|k8s/') then 'infrastructure'
 when regexp_matches(lower(file_path), '/frontend/|/web/|/ui/|/client/|/static/|/components/|src/pages/|src/app/|/views/') then 'frontend' else 'backend' end"""


@query(
    f"""with f as (select distinct file_path, {DOMAIN_SQL} d from indexed_functions)
select d as file_domain, count(*) files, array_to_string(list_sort(list(file_path))[:20], ',') sample from f group by 1"""
)
def domain_statistics(spark: SparkSession, root: str) -> DataFrame:
    """Files of each domain, with the first twenty of them."""
    f = table(spark, root, "indexed_functions").select("file_path").distinct().withColumn("file_domain", classify_domain(F.col("file_path")))
    first = Window.partitionBy("file_domain").orderBy("file_path")
    top = f.withColumn("_r", F.row_number().over(first)).filter("_r <= 20").groupBy("file_domain").agg(F.array_join(F.sort_array(F.collect_list("file_path")), ",").alias("sample"))
    return f.groupBy("file_domain").agg(F.count(F.lit(1)).alias("files")).join(top, "file_domain")


@query(
    f"""with c as (select unnest(['orm_count_in_loop', 'transaction_x', 'raw_sql_injection', 'n_plus_one', 'fk_x', 'migration_x', 'style', 'Secret']) category, 1 k), f as (select distinct file_path, 1 k from indexed_functions)
select category, file_path, case when regexp_matches(lower(category), '^(orm_|transaction|n_plus_one|fk_|migration)|sql') then 'database' else {DOMAIN_SQL} end issue_domain from c join f using (k)"""
)
def issue_domains(spark: SparkSession, root: str) -> DataFrame:
    """Domain of an issue by its category, else by its file."""
    names = ("orm_count_in_loop", "transaction_x", "raw_sql_injection", "n_plus_one", "fk_x", "migration_x", "style", "Secret")
    f = table(spark, root, "indexed_functions").select("file_path").distinct().withColumn("category", F.explode(F.array(*[F.lit(x) for x in names])))
    return f.select("category", "file_path", issue_domain(F.col("file_path"), F.col("category")).alias("issue_domain"))


# ---- sources written from the index and read back


#: A function of each kind of habit; NAME stands for its name.  Every text has nine lines.
HABITS = (
    "def NAME(cur, x):\n    log.info('in NAME')\n    cur.execute(f'SELECT a FROM t WHERE id={x}')\n    return helper(x)\n\n\n\n\n",
    "def NAME(session):\n    for o in Order.objects.all():\n        n = Item.objects.filter(order=o).count()\n    return n\n\n\n\n\n",
    "def NAME(session):\n    for o in Order.objects.prefetch_related('x').all():\n        print(o.lot.name)\n        for i in o.items.all():\n            i.touch()\n\n\n\n",
    "def NAME(session):\n    for o in Order.objects.select_related('lot').all():\n        a = o.items.filter(x=1)\n        session.commit()\n    return a\n\n\n\n",
    "def NAME(x):\n    Order.objects.create(a=x)\n    Item.objects.update(a=x)\n    Lot.objects.delete()\n    with transaction.atomic():\n        Other.objects.create()\n    return 1\n\n",
)
#: What each habit is found as, and its line from the function's first.
FOUND = (
    (0, "raw_sql_injection", "CRITICAL", 2),
    (1, "orm_count_in_loop", "HIGH", 2),
    (1, "n_plus_one", "CRITICAL", 2),
    (2, "orm_missing_select_related", "HIGH", 2),
    (2, "n_plus_one", "MEDIUM", 2),
    (2, "orm_missing_select_related", "HIGH", 3),
    (2, "n_plus_one", "MEDIUM", 3),
    (3, "orm_missing_prefetch_related", "HIGH", 2),
    (3, "transaction_commit_in_loop", "HIGH", 3),
    (4, "transaction_missing_atomic", "HIGH", 1),
)
PLACED = "p as (select *, row_number() over (partition by app_name, file_path order by id) - 1 k from indexed_functions)"


def habit_files(spark: SparkSession, root: str) -> DataFrame:
    """One Python file for each indexed file, with its functions in order of their ids."""
    f = table(spark, root, "indexed_functions").select(F.concat_ws("/", "app_name", "file_path").alias("path"), "id", "function_name")
    text = F.element_at(F.array(*[F.lit(h) for h in HABITS]), (F.col("id") % len(HABITS) + 1).cast("int"))
    f = f.withColumn("t", F.replace(text, F.lit("NAME"), F.col("function_name")))
    whole = f.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "t"))), lambda x: x["t"]), "\n").alias("content"))
    return whole.withColumn("code_language", F.lit("python"))


@query(
    f"""with {PLACED} select app_name || '/' || file_path as path, function_name, (9 * k + 1)::int line_number, (9 * k + case id % 5 when 0 then 4 when 1 then 4 when 2 then 5 when 3 then 5 else 7 end)::int end_line_number from p"""
)
def round_trip_functions(spark: SparkSession, root: str) -> DataFrame:
    return codeindex.functions(habit_files(spark, root)).select("path", "function_name", "line_number", "end_line_number")


@query(
    f"""with {PLACED}, h as (select * from (values {", ".join(str(f) for f in FOUND)}) t(h, category, severity, d))
select app_name || '/' || file_path as path, category, severity, (9 * k + d + 1)::int line_number from p join h on h.h = p.id % 5"""
)
def round_trip_findings(spark: SparkSession, root: str) -> DataFrame:
    return codeindex.findings(habit_files(spark, root)).select("path", "category", "severity", "line_number")


@query(f"with {PLACED} select 'in ' || function_name as log_string, 'info' as log_level, count(*) over (partition by function_name) > 0 as known from p where id % 5 = 0 qualify row_number() over (partition by function_name order by id) = 1")
def round_trip_log_texts(spark: SparkSession, root: str) -> DataFrame:
    return codeindex.log_calls(habit_files(spark, root)).select("log_string", "log_level", (F.col("line_number") > 0).alias("known"))


@query(
    f"""with {PLACED}, o as (select * from (values (1, 'query', 'Order', 1, false), (1, 'query', 'Item', 2, true), (1, 'count', 'Item', 2, true), (2, 'query', 'Order', 1, false), (3, 'query', 'Order', 1, false),
  (4, 'insert', 'Order', 1, false), (4, 'update', 'Item', 2, false), (4, 'delete', 'Lot', 3, false), (4, 'insert', 'Other', 5, false)) t(h, op_type, table_hint, d, in_loop))
select app_name || '/' || file_path as path, op_type, table_hint, (9 * k + d + 1)::int line_number, in_loop from p join o on o.h = p.id % 5"""
)
def round_trip_operations(spark: SparkSession, root: str) -> DataFrame:
    return codeindex.operations(habit_files(spark, root)).select("path", "op_type", "table_hint", "line_number", "in_loop")


@query(
    f"""with {PLACED}, h as (select * from (values {", ".join(str(f) for f in FOUND)}) t(h, category, severity, d)),
i as (select distinct app_name || '/' || file_path as file_path, k, category from p join h on h.h = p.id % 5 where category <> '' )
select case when regexp_matches(lower(category), '^(orm_|transaction|n_plus_one|fk_|migration)|sql') then 'database' else {DOMAIN_SQL} end issue_domain, category,
  (select count(*) from p join h on h.h = p.id % 5 where h.category = i.category)::bigint issues from i group by all"""
)
def static_issues(spark: SparkSession, root: str) -> DataFrame:
    """Issues of the written sources by domain and category."""
    issues, _ = codeindex.static_report(habit_files(spark, root))
    return issues.filter("category <> 'security_signal'").groupBy("issue_domain", "category").agg(F.count(F.lit(1)).alias("issues"))
