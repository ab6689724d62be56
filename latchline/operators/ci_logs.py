"""CI logs: sections of an archive or groups of a flat log, rolled up into steps.

Lines are ``(file, line_no, line)``.  Lines with a null file or number are left out;
null and unreadable lines belong to no step; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latchline.functions.units import iso_us
from latchline.operators.ordered import CHUNK, with_neighbour, with_running

# Layout of a line, its annotations, and section headers.
STAMPED = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z)\s+(.*)$"
ANNOTATED = r"^##\[(group|endgroup|error|warning)\](.*)$"
HEADER = r"^===\s+(.+?)\s+===$"
NUMBERED = r"^(\d+)_(.+)$"
#: Characters an excerpt keeps, half from each end where there are more, and what marks the cut.
EXCERPT, CUT_MARK = 2000, "\n... [truncated] ...\n"


def read_lines(lines: DataFrame) -> DataFrame:
    """Adds ``ts_us, annotation, message``; null ``ts_us`` means the line isn't one of a CI log."""
    rows = lines.select("file", F.col("line_no").cast("long").alias("line_no"), F.rtrim(F.regexp_replace("line", "[\r\n]+$", "")).alias("line"))
    rows = rows.filter("file is not null and line_no is not null")
    rest = F.regexp_extract("line", STAMPED, 2)
    kind = F.nullif(F.regexp_extract(rest, ANNOTATED, 1), F.lit(""))
    # Fractions have up to seven digits; six are kept.
    stamp = F.regexp_replace(F.nullif(F.regexp_extract("line", STAMPED, 1), F.lit("")), r"(\.\d{1,6})\d*Z$", "$1Z")
    return rows.withColumn("ts_us", iso_us(stamp)).withColumn("annotation", kind).withColumn("message", F.when(kind.isNull(), rest).otherwise(F.trim(F.regexp_extract(rest, ANNOTATED, 2)))).withColumn("raw_message", rest)


def header_step(header: Column) -> tuple[Column, Column]:
    """Step name and number of a section header; a null name marks files of the runner itself, which are no steps."""
    path = F.regexp_replace(header, r"\.txt$", "")
    foldered = path.contains("/")
    part = F.when(foldered, F.element_at(F.split(path, "/"), -1)).otherwise(F.trim(path))
    number = F.regexp_extract(part, NUMBERED, 1)
    name = F.when(number != "", F.trim(F.regexp_extract(part, NUMBERED, 2))).when(~foldered, part)
    return name, F.coalesce(number.try_cast("int"), F.lit(0))


def _excerpts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, log_excerpt``: the messages of each step, long ones cut in their middle.

    Running lengths tell which lines reach into the kept ends, so a step of any size gives few lines.
    """
    half = EXCERPT // 2
    sized = rows.select("file", *[k for k in keys if k != "file"], "line_no", "_c", F.coalesce("raw_message", F.lit("")).alias("_t"))
    sized = sized.withColumn("_len", (F.length("_t") + 1).cast("long"))
    sized = with_running(sized, ["file"], "_c", ["line_no"], F.col("_len"), "_upto")
    ends = sized.groupBy(*keys).agg(F.min(F.col("_upto") - F.col("_len")).alias("_from"), F.max("_upto").alias("_to"))
    near = sized.join(ends, keys).withColumn("_size", F.col("_to") - F.col("_from") - 1)
    head = F.col("_upto") - F.col("_len") - F.col("_from") < F.when(F.col("_size") <= EXCERPT, EXCERPT + 1).otherwise(half)
    tail = (F.col("_to") - F.col("_upto") < half) & (F.col("_size") > EXCERPT)
    near = near.filter(head | tail)
    part = lambda test, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("line_no", text.alias("_t"))))), lambda x: x["_t"]), "\n")
    text = near.groupBy(*keys, "_size").agg(part(head, F.substring("_t", 1, EXCERPT)).alias("_head"), part(tail, F.right("_t", F.lit(half))).alias("_tail"))
    whole = F.col("_size") <= EXCERPT
    cut = F.concat(F.substring("_head", 1, half), F.lit(CUT_MARK), F.right("_tail", F.lit(half)))
    return text.select(*keys, F.when(whole, F.col("_head")).otherwise(cut).alias("log_excerpt"))


def _roll_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Times, status, last annotation and excerpt of each step from its lines."""
    noted = F.when(F.col("annotation").isin("error", "warning") & F.col("counts"), F.col("annotation"))
    out = rows.groupBy(*keys).agg(
        F.min("ts_us").alias("started_us"), F.max("ts_us").alias("ended_us"), F.count(F.lit(1)).alias("lines"),
        F.max_by(noted, F.when(noted.isNotNull(), F.col("line_no"))).alias("annotation"), F.coalesce(F.bool_or(noted == "error"), F.lit(False)).alias("_bad"),
        F.min("line_no").alias("first_line_no"), F.max("line_no").alias("last_line_no"),
    )
    out = out.select(
        *keys, "first_line_no", "last_line_no", "lines", "started_us", "ended_us", F.expr("(ended_us - started_us) div 1000").alias("duration_ms"),
        F.when(F.col("_bad"), "failure").otherwise("success").alias("status"), "annotation",
    )
    return out.join(_excerpts(rows, keys), keys)


def archive_steps(lines: DataFrame) -> DataFrame:
    """Steps of logs with section headers: ``file, section_no, step_name, step_number, ...``.

    A header opens a section; sections without a readable line, and those of the runner, give
    no step; a section without a number gets its place among the file's steps.
    """
    rows = read_lines(lines).withColumn("_h", F.nullif(F.regexp_extract("line", HEADER, 1), F.lit(""))).withColumn("_c", F.floor(F.col("line_no") / CHUNK))
    rows = with_running(rows, ["file"], "_c", ["line_no"], F.col("_h").isNotNull().cast("long"), "section_no")
    name, number = header_step(F.col("_h"))
    heads = rows.filter("_h is not null").select("file", "section_no", name.alias("step_name"), number.alias("step_number"))
    body = rows.filter("_h is null and ts_us is not null and section_no > 0").withColumn("counts", F.lit(True))
    steps = _roll_up(body, ["file", "section_no"]).join(heads, ["file", "section_no"]).filter("step_name is not null")
    steps = steps.withColumn("_c", F.floor(F.col("section_no") / CHUNK))
    steps = with_running(steps, ["file"], "_c", ["section_no"], F.lit(1), "_place")
    return steps.withColumn("step_number", F.when(F.col("step_number") > 0, F.col("step_number")).otherwise(F.col("_place")).cast("int")).drop("_c", "_place")


def flat_steps(lines: DataFrame) -> DataFrame:
    """Steps of logs with group marks: a group opens a step, an endgroup closes the open one.

    Lines outside of steps form an implicit step "Setup" with number 0; its own first line
    doesn't count towards its status.  Whether an endgroup closes depends on the endgroups right before
    it: of a stretch of them every other one closes, beginning with the first unless nothing is open at the file's start.
    """
    rows = read_lines(lines).filter("ts_us is not null").withColumn("_c", F.floor(F.col("line_no") / CHUNK))
    rows = rows.withColumn("_end", F.coalesce(F.col("annotation") == "endgroup", F.lit(False)))
    order = (["file"], "_c", ["line_no"])
    rows = with_running(rows, *order, F.lit(1), "_n")
    rows = with_running(rows, *order, (~F.col("_end")).cast("long"), "_stretch")
    # Place of an endgroup in its stretch: rows since the last other line.
    last = rows.filter("not _end").select("file", "_stretch", F.col("_n").alias("_at"))
    rows = rows.join(last, ["file", "_stretch"], "left").withColumn("_place", F.col("_n") - F.coalesce("_at", F.lit(0)))
    odd = F.col("_place") % 2 == 1
    rows = rows.withColumn("_closes", F.col("_end") & F.when(F.col("_at").isNull(), ~odd).otherwise(odd))
    rows = with_neighbour(rows, *order, {"_closed": "_closes"})
    opens = F.coalesce(F.col("annotation") == "group", F.lit(False))
    begins = opens | F.coalesce("_closed", F.lit(True))
    rows = with_running(rows.withColumn("_b", begins), *order, F.col("_b").cast("long"), "section_no")
    named = rows.filter("_b").select("file", "section_no", opens.alias("_group"), F.col("message").alias("_name"))
    body = rows.withColumn("counts", ~F.col("_b"))
    steps = _roll_up(body, ["file", "section_no"]).join(named, ["file", "section_no"])
    number = F.when(F.col("_group"), F.col("section_no")).otherwise(0)
    name = F.when(~F.col("_group"), "Setup").when(F.col("_name") == "", F.concat(F.lit("Step "), F.col("section_no").cast("string"))).otherwise(F.col("_name"))
    return steps.withColumn("step_name", name).withColumn("step_number", number.cast("int")).drop("_group", "_name")


def clean_line(line: Column) -> Column:
    """A line without time and annotation mark."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"^\d{4}-\d{2}-\d{2}T[\d:.]+Z\s*", ""), r"##\[\w+\]", ""))
