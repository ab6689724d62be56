"""Indexing source files: functions, log calls and findings as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latchline.functions.sourcecode import frameworks, read_source
from latchline.operators.text_rules import SEVERITIES, issue_domain, most_interesting, security_signals, stable_id


def _rows(kind: str, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text, language in zip(b["path"], b["content"], b["code_language"], strict=True):
                out.extend({"path": path, **x} for x in getattr(read_source(text, language), kind))
            if out:  # an empty frame has no type for lists
                yield pd.DataFrame(out, columns=["path", *columns])

    return run


def functions(files: DataFrame) -> DataFrame:
    """``path, function_name, qualified_name, line_number, end_line_number, calls`` from ``path, content, code_language``."""
    cols = ["function_name", "qualified_name", "line_number", "end_line_number", "calls"]
    return files.mapInPandas(_rows("functions", cols), "path string, function_name string, qualified_name string, line_number int, end_line_number int, calls array<string>")


def log_calls(files: DataFrame) -> DataFrame:
    """Texts given to log methods, the first place of each text per path counting once."""
    cols = ["log_string", "line_number", "function_name", "log_level"]
    got = files.mapInPandas(_rows("logs", cols), "path string, log_string string, line_number int, function_name string, log_level string")
    first = got.groupBy("log_string").agg(F.min_by(F.struct("path", "line_number", "function_name", "log_level"), F.struct("path", "line_number")).alias("x"))
    return first.select("log_string", "x.*")


def findings(files: DataFrame) -> DataFrame:
    """Database habits that cost time or safety, with a stable id."""
    cols = ["category", "severity", "line_number", "code"]
    got = files.mapInPandas(_rows("findings", cols), "path string, category string, severity string, line_number int, code string")
    return got.withColumn("id", F.left(F.sha2(F.concat_ws(":", F.lit("L1"), "category", "path", F.col("line_number").cast("string"), F.lit("")), 256), F.lit(32)))


def used_frameworks(files: DataFrame) -> DataFrame:
    """Database libraries per file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "frameworks": [frameworks(t, c) for t, c in zip(b["content"], b["code_language"], strict=True)]})

    return files.select("path", "content", "code_language").mapInPandas(run, "path string, frameworks array<string>")


def operations(files: DataFrame) -> DataFrame:
    """Database operations of models: what each does, on which table, and whether in a loop."""
    cols = ["op_type", "table_hint", "line_number", "end_line_number", "in_loop", "select_related", "prefetch_related"]
    shape = "path string, op_type string, table_hint string, line_number int, end_line_number int, in_loop boolean, select_related boolean, prefetch_related boolean"
    got = files.mapInPandas(_rows("operations", cols), shape)
    return got.withColumn("id", stable_id("path", "line_number", "op_type", "table_hint"))


def static_report(files: DataFrame, per_domain: int = 45, chars: int = 14_000) -> tuple[DataFrame, DataFrame]:
    """``(issues, top_files)`` of a code base: findings and risky constructs by domain, the gravest first, and the files most worth a look."""
    found = findings(files).select("path", "category", "severity", "line_number", "code")
    risky = files.select("path", F.explode(security_signals(F.col("content"))).alias("code"))
    risky = risky.select("path", F.lit("security_signal").alias("category"), F.lit("medium").alias("severity"), F.lit(None).cast("int").alias("line_number"), "code")
    merged = found.withColumn("severity", F.lower("severity")).unionByName(risky).withColumn("issue_domain", issue_domain(F.col("path"), F.col("category")))
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    order = Window.partitionBy("issue_domain").orderBy(F.when(rank == 0, 99).otherwise(rank), "path", "line_number", "category", "code")
    issues = merged.withColumn("rank_no", F.row_number().over(order))
    counts = found.groupBy("path").agg(F.count(F.lit(1)).alias("findings"))
    return issues, most_interesting(files.select("path", "content").join(counts, "path", "left").fillna(0, ["findings"]), per_domain, chars)
