"""Queries of the training-data problems and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latchline.llm.languages import document_languages, language_spans, line_languages
from latchline.llm.leaks import CLOSE, RARE_SHARE, SHARE, leaked_items
from latchline.llm.mixture import mixture
from latchline.llm.quantiles import merged, percentiles, sketch_values
from latchline.llm.runs import event_runs, known_functions
from latchline.llm.topn import top_per_group
from latchline.tables import table

QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    records = table(spark, root, "universal_log_records").select("session_id", "line_no", "record_id", "func_name", "logged_at")
    known = known_functions(records, table(spark, root, "app_log_sessions"), table(spark, root, "indexed_functions"), "session_id", "func_name", "function_id")
    return event_runs(known, "session_id", "line_no", "record_id", "function_id", "logged_at").filter("run_length >= 2")


P1_SQL = """
with k as (
  select u.session_id s, u.line_no p, u.record_id i, f.id f, epoch_us(u.logged_at) t
  from universal_log_records u left join app_log_sessions a on a.id = u.session_id
  left join indexed_functions f on f.app_name = a.app_name
    and lower(f.function_name) = lower(regexp_extract(trim(u.func_name), '^[A-Za-z0-9_$]+'))
),
o as (select * from k qualify row_number() over (partition by s, p order by i) = 1),
b as (select *, row_number() over w n, case when f = lag(f) over w and abs(t - lag(t) over w) <= 60000000 then 0 else 1 end b
      from o window w as (partition by s order by p)),
g as (select *, sum(b) over (partition by s order by p rows unbounded preceding) g from b)
select s as session_id, min(p) as first_line_no, max(p) as last_line_no, count(*) as run_length,
  (arg_max(t, p) - arg_min(t, p)) // 1000 as span_ms
from g group by s, g having count(*) >= 2
"""


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    calls = table(spark, root, "app_function_calls")
    best = top_per_group(calls, ["session_id", "function_name"], "duration_ms", "id", 3, "call_number")
    return best.withColumnRenamed("item_id", "call_id")


P2_SQL = """
with once as (select * from app_function_calls qualify row_number() over (partition by session_id, function_name, call_number order by id) = 1),
r as (select session_id, function_name, id, row_number() over (partition by session_id, function_name order by duration_ms desc, id) n
      from once where duration_ms is not null)
select session_id, function_name, cast(n as int) as rank_no, id as call_id from r where n <= 3
"""


def _daily(spark: SparkSession, root: str) -> DataFrame:
    steps = table(spark, root, "step_timings").select("pipeline_run_id", "step_name", "duration_ms")
    runs = table(spark, root, "pipeline_runs").select(F.col("id").alias("pipeline_run_id"), F.to_date("created_at").alias("day"))
    return merged(sketch_values(steps.join(runs, "pipeline_run_id", "left"), ["step_name", "day"], "duration_ms"), ["step_name", "day"])


def p3_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles per step over all time, joined from daily sketches."""
    return percentiles(merged(_daily(spark, root), ["step_name"]), ["step_name"], QUANTILES)


def p3_monthly(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles per step and month, joined from daily sketches."""
    months = _daily(spark, root).withColumn("month", F.date_format("day", "yyyy-MM"))
    return percentiles(merged(months, ["step_name", "month"]), ["step_name", "month"], QUANTILES)


def p3_within_error(spark: SparkSession, root: str) -> DataFrame:
    """Exact counts beside the sketches: are all answers within the stated error?"""
    from latchline.llm.quantiles import rank_error

    got = p3_percentiles(spark, root)
    pairs = got.select("step_name", F.explode(F.map_from_arrays(F.array(*[F.lit(q) for q in QUANTILES.values()]), F.array(*QUANTILES))).alias("q", "v"))
    values = table(spark, root, "step_timings").select("step_name", "duration_ms").filter("duration_ms is not null")
    # Four answers for each of a few steps: grouped before the join, so each value meets four rows.
    answers = pairs.groupBy("step_name").agg(F.collect_list(F.struct("q", "v")).alias("a"))
    met = values.join(answers, values["step_name"].eqNullSafe(answers["step_name"])).select(values["step_name"], "duration_ms", F.explode("a").alias("a"))
    ranks = met.groupBy("step_name", "a.q").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("duration_ms") < F.col("a.v")).alias("lo"), F.count_if(F.col("duration_ms") <= F.col("a.v")).alias("hi")
    )
    off = F.greatest(F.col("lo") + 1 - F.ceil(F.col("q") * F.col("n")), F.ceil(F.col("q") * F.col("n")) - F.col("hi"), F.lit(0))
    fine = off <= F.lit(rank_error()) * (1 - F.col("q")) * F.col("n") + 1
    return ranks.groupBy("step_name").agg(F.max("n").alias("n"), F.count_if(fine).alias("within"))


P3_SQL = "select step_name, count(duration_ms) as n, 4 as within from step_timings where duration_ms is not null group by step_name"


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return leaked_items(table(spark, root, "documents"), table(spark, root, "eval_items")).select("doc_id", "item_id")


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """Leaks with the shares of words and rare words found."""
    return leaked_items(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p9_mixture(spark: SparkSession, root: str) -> DataFrame:
    return mixture(table(spark, root, "documents"), table(spark, root, "mix_targets"), "doc_id", "source", "text")[0]


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixture(table(spark, root, "documents"), table(spark, root, "mix_targets"), "doc_id", "source", "text")[1]


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    lines = line_languages(table(spark, root, "documents"))
    return lines.filter("mislabelled or languages > 1").select("doc_id", "line_no", "seg_lang")


def p10_documents(spark: SparkSession, root: str) -> DataFrame:
    """Main language and confidence of every document with prose."""
    return document_languages(line_languages(table(spark, root, "documents")))


def p10_spans(spark: SparkSession, root: str) -> DataFrame:
    """Stretches of one language inside the lines of all documents."""
    return language_spans(table(spark, root, "documents")).drop("span_words")


def p10_spans_cover(spark: SparkSession, root: str) -> DataFrame:
    """Do the stretches of each line follow one another without gap, change the language each time and have a confidence between 0 and 1?"""
    s = language_spans(table(spark, root, "documents"))
    line = Window.partitionBy("doc_id", "line_no").orderBy("span_no")
    follows = F.col("first_word") == F.coalesce(F.lag("end_word").over(line), F.lit(0))
    changes = F.coalesce(F.lag("seg_lang").over(line) != F.col("seg_lang"), F.lit(True))
    sure = F.col("confidence").between(0, 1) & (F.size(F.split("span_words", " ")) == F.col("end_word") - F.col("first_word"))
    return s.select((follows & changes & sure).alias("fine")).agg(F.bool_and("fine").alias("fine"))


def p10_labels(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose label names a language that their main language, and every one of their lines, confirms, by label."""
    lines = line_languages(table(spark, root, "documents"))
    each = lines.groupBy("doc_id", "named").agg(F.count_distinct("seg_lang").alias("held"), F.max("seg_lang").alias("lang"), F.min("confidence").alias("low"), F.max("confidence").alias("high"))
    fine = (F.col("held") >= 1) & (F.col("low") >= 0) & (F.col("high") <= 1)
    return each.agg(F.bool_and(fine).alias("confidence_fine"), (F.count_if((F.col("held") == 1) & (F.col("named") == F.col("lang"))) > 0.6 * F.count_if(F.col("named").isNotNull())).alias("labels_mostly_confirmed"))


def p9_mixture_adds_up(spark: SparkSession, root: str) -> DataFrame:
    """Per target: documents and size counted again, no copy beyond the cap, and the budget met to within a document or the cap used up."""
    docs, targets = table(spark, root, "documents"), table(spark, root, "mix_targets")
    chosen, shares = mixture(docs, targets, "doc_id", "source", "text")
    used = chosen.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("sum_used"), F.max("copies").alias("most"), F.max("tokens").alias("largest"), F.count_distinct("doc_id").alias("n_ids"), F.count(F.lit(1)).alias("n_rows"))
    s = shares.join(used, "source", "left").fillna(0, ["sum_used", "most", "largest", "n_ids", "n_rows"])
    short = F.col("tokens_wanted") - F.col("tokens_used")
    met = short.between(0, F.col("largest")) | (F.col("tokens_used") == F.col("tokens_available") * F.col("max_repeats"))
    return s.select(
        "source", "max_repeats", "documents", (F.col("sum_used") == F.col("tokens_used")).alias("adds_up"), (F.col("most") <= F.col("max_repeats")).alias("within_cap"),
        met.alias("budget_met"), (F.col("n_ids") == F.col("n_rows")).alias("each_once"),
    )


P9_SQL = """
select t.source, t.max_repeats, (select count(*) from documents d where d.source = t.source) as documents,
  true as adds_up, true as within_cap, true as budget_met, true as each_once
from mix_targets t
"""


def p8_shares_hold(spark: SparkSession, root: str) -> DataFrame:
    """Do all leaks have the shares that the statement asks for, each pair once?"""
    s = leaked_items(table(spark, root, "documents"), table(spark, root, "eval_items"))
    fine = (F.col("word_share") >= SHARE) & (F.col("rare_share") >= RARE_SHARE) & (F.col("closeness") >= CLOSE) & (F.col("phrase_words") >= 1) & (F.greatest("word_share", "rare_share", "closeness") <= 1)
    return s.agg(F.bool_and(fine).alias("fine"), (F.count(F.lit(1)) == F.count_distinct("doc_id", "item_id")).alias("each_once"))


def p8_exact_copies(spark: SparkSession, root: str) -> DataFrame:
    """Of the leaks the ones that hold an item letter for letter, letter case and outer blanks aside."""
    items = table(spark, root, "eval_items").select("item_id", F.lower(F.trim("text")).alias("i"))
    docs = table(spark, root, "documents").select("doc_id", F.lower("text").alias("d"))
    found = leaked_items(table(spark, root, "documents"), table(spark, root, "eval_items")).select("doc_id", "item_id")
    return found.join(docs, "doc_id").join(items, "item_id").filter(F.col("d").contains(F.col("i"))).select("doc_id", "item_id")


P8_EXACT_SQL = "select doc_id, item_id from documents d join eval_items i on contains(lower(d.text), lower(trim(i.text)))"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p3_percentiles, p3_monthly, p3_within_error, p8_found, p8_shares, p8_shares_hold, p8_exact_copies, p9_mixture, p9_shares, p9_mixture_adds_up, p10_found, p10_documents, p10_spans, p10_spans_cover, p10_labels)
}
SQL: dict[str, str] = {
    "p1_found": P1_SQL,
    "p2_found": P2_SQL,
    "p3_within_error": P3_SQL,
    "p8_exact_copies": P8_EXACT_SQL,
    "p8_shares_hold": "select true as fine, true as each_once",
    "p9_mixture_adds_up": P9_SQL,
    "p10_spans_cover": "select true as fine",
    "p10_labels": "select true as confidence_fine, true as labels_mostly_confirmed",
}
