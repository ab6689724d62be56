"""Reading logs, archives, tables and sources from files, and writing results back."""

from __future__ import annotations

import hashlib
import hmac
import io
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latchline.functions.units import first_of
from latchline.tables import table

# Names of the stored tables.
TABLES = (
    "tracked_repositories", "pipeline_runs", "step_timings", "app_log_sessions", "app_function_calls",
    "universal_log_records", "parsed_function_calls", "indexed_functions", "raw_log_lines", "documents",
)
# Languages by file ending.
ENDINGS = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".c": "c", ".h": "c"}


def register(spark: SparkSession, root: str) -> list[str]:
    """Every stored table as a view, so that ``spark.sql`` reads them by name."""
    found = [t for t in TABLES if Path(f"{root}/{t}.parquet").exists()]
    for t in found:
        table(spark, root, t).createOrReplaceTempView(t)
    return found


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)`` of text files, numbered from 1.

    A file is read whole so that its line numbers hold; for files too large for that,
    write the numbers with the lines.
    """
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("file", F.input_file_name())
    parts = whole.select("file", F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("_n", "line"))
    return parts.select("file", (F.col("_n") + 1).cast("long").alias("line_no"), "line").filter(F.col("line_no").isNotNull())


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, content in zip(b["path"], b["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in sorted(n for n in z.namelist() if n.endswith(".txt") or n.lower().endswith(".log")):
                    lines = z.read(name).decode("utf-8", "replace").split("\n")
                    yield pd.DataFrame({"file": path, "entry": name, "line_no": range(1, len(lines) + 1), "line": lines})


def zip_lines(spark: SparkSession, path: str, most_bytes: int = 50 << 20) -> DataFrame:
    """Lines of the text entries of zip archives up to a size."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).filter(F.col("length") <= most_bytes)
    return found.select("path", "content").mapInPandas(_entries, "file string, entry string, line_no long, line string")


def source_files(spark: SparkSession, root: str, most_kb: int = 2048) -> DataFrame:
    """``(path, content, code_language)`` of source files below ``root``, without version control's own."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ending = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    kinds = F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair])
    kept = found.filter((F.col("length") <= most_kb * 1024) & ~F.col("path").contains("/.git/"))
    return kept.select("path", F.col("content").cast("string").alias("content"), F.try_element_at(kinds, ending).alias("code_language")).filter("code_language is not null")


def inside(path: str, allowed: str) -> bool:
    """Whether a path lies below an allowed folder, links followed."""
    return Path(path).resolve().is_relative_to(Path(allowed).resolve())


def packet_rows(spark: SparkSession, path: str) -> DataFrame:
    """Packets of a tab-separated export as lines ``label  elapsed=...s``; rows without a time are skipped."""
    rows = spark.read.option("sep", "\t").option("header", "true").csv(path)
    column = lambda part: next((c for c in rows.columns if part in c), None)
    delta, protocols = column("time_delta") or column("delta"), column("protocols")
    if not delta or not protocols:
        raise ValueError("the export names neither a time difference nor protocols")
    label = first_of(F.regexp_replace(F.element_at(F.split(F.col(f"`{protocols}`"), ":"), -1), r"\W", "_"), F.lit("frame"))
    out = rows.select(label.alias("label"), F.col(f"`{delta}`").try_cast("double").alias("seconds")).filter("seconds is not null")
    return out.withColumn("line", F.format_string("%s  elapsed=%.6fs", "label", "seconds"))


def write_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces just the partitions that ``df`` holds; each replacement is atomic, so a repeat changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def only_new(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys ``known`` lacks, each key once."""
    return df.join(known.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def signature_valid(secret: str):
    """A column function telling whether a body carries the HMAC-SHA256 signature given with it."""

    @F.pandas_udf(T.BooleanType())
    def valid(body: pd.Series, given: pd.Series) -> pd.Series:
        def one(b, g) -> bool:
            want = "sha256=" + hmac.new(secret.encode(), (b or "").encode(), hashlib.sha256).hexdigest()
            return hmac.compare_digest(want, g or "")

        return pd.Series([one(b, g) for b, g in zip(body, given, strict=True)])

    return valid


def seconds_text(ms: Column) -> Column:
    """Milliseconds as seconds with one decimal."""
    return F.format_string("%.1fs", ms / 1000)
