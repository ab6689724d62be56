"""Log lines of many layouts, parsed into multi-line entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latchline.functions.loglines import read_header
from latchline.operators.ordered import CHUNK, with_neighbour, with_running
from latchline.session import stored

#: Characters an excerpt keeps.
EXCERPT_CHARS = 2000
_HEADER = "_us bigint, _level string, _component string, _message string, _unparsed string"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [read_header(raw, int(y)) or (None, None, None, None, None) for raw, y in zip(b["_raw"], b["_year"], strict=True)]
        head = pd.DataFrame(rows, columns=["_us", "_level", "_component", "_message", "_unparsed"], index=b.index)
        head["_us"] = head["_us"].astype("Int64")
        yield pd.concat([b[["_session", "_line", "_id", *(["_keep"] if "_keep" in b else [])]], head], axis=1)


def log_entries(
    lines: DataFrame,
    sessions: DataFrame,
    session: str = "session_id",
    line_no: str = "line_no",
    line_id: str = "line_id",
    raw: str = "raw_line",
    excerpts: bool = False,
    chunk: int = CHUNK,
) -> DataFrame:
    """Entries ``(session_id, first_line_no, last_line_no, entry_us, log_level, component, message, unparsed)``.

    ``sessions`` has ``id`` and ``created_at``, whose year completes times without one.
    Each line's header is parsed by a weighted grammar (Earley); the lines from one
    header to the next, continuations by the same grammar, are an entry.  ``unparsed`` is what
    the best parse of the header left over.  With ``excerpts`` the columns ``raw_line`` (the
    whole first line) and ``log_excerpt`` (the entry, cut at 2000 characters) are added.

    Of repeated lines (same session and line number) the lowest ``line_id`` counts;
    lines with null session or number have no place and are left out; null, empty and
    very long lines are continuations unless they open with a layout's fields; lines
    before a file's first entry belong to none; a session without a row in
    ``sessions`` reads yearless times in 1970; empty tables give no rows; extra
    columns are ignored.
    """
    made = sessions.select(F.col("id").alias("_session"), F.year("created_at").cast("int").alias("_year")).dropDuplicates(["_session"])
    rows = lines.select(
        F.col(session).alias("_session"), F.col(line_no).alias("_line"), F.col(line_id).alias("_id"), F.col(raw).alias("_raw")
    ).filter("_session is not null and _line is not null")
    rows = rows.join(made, "_session", "left").fillna(1970, ["_year"])
    kinds = dict(rows.dtypes)
    shape = f"_session {kinds['_session']}, _line {kinds['_line']}, _id {kinds['_id']}"
    if excerpts:
        rows = rows.withColumn("_keep", F.col("_raw"))
        shape += ", _keep string"
    # Written once: every line is parsed once, and the passes below read the columns they need.
    read = stored(rows.mapInPandas(_read, f"{shape}, {_HEADER}"), "entries-read").withColumn("_chunk", F.floor(F.col("_line") / chunk))
    inside = Window.partitionBy("_session", "_chunk").orderBy("_line", "_id")
    once = read.withColumn("_before", F.lag("_line").over(inside)).filter("_before is null or _before <> _line").drop("_before")
    slim = once.select("_session", "_chunk", "_line", "_id", F.col("_us").isNotNull().alias("_head"))
    near = with_neighbour(slim, ["_session"], "_chunk", ["_line", "_id"], {"_previous": "_line"})
    ends = slim.groupBy("_session").agg(F.max("_line").alias("_final"))
    heads = with_neighbour(near.filter("_head"), ["_session"], "_chunk", ["_line", "_id"], {"_last": "_previous"}, step=-1)
    heads = heads.join(ends, "_session").select(F.col("_session").alias("_s"), F.col("_line").alias("_l"), F.col("_id").alias("_i"), F.coalesce("_last", "_final").alias("_last"))
    # Only narrow rows were sorted; the fields join the chosen lines, both laid out by the same keys.
    fields = read.filter("_us is not null").dropDuplicates(["_session", "_line", "_id"])
    out = fields.join(heads, (F.col("_session") == F.col("_s")) & (F.col("_line") == F.col("_l")) & F.col("_id").eqNullSafe(F.col("_i"))).select(
        F.col("_session").alias(session),
        F.col("_line").cast("long").alias("first_line_no"),
        F.col("_last").cast("long").alias("last_line_no"),
        F.col("_us").alias("entry_us"),
        F.col("_level").alias("log_level"),
        F.col("_component").alias("component"),
        F.col("_message").alias("message"),
        F.col("_unparsed").alias("unparsed"),
        *([F.col("_keep").alias("raw_line")] if excerpts else []),
    )
    if not excerpts:
        return out
    # Lines are numbered by their entry; of each entry those count that begin within the excerpt, whatever their number.
    size = F.coalesce(F.length("_keep") + 1, F.lit(0))
    sized = once.select("_session", "_chunk", "_line", "_id", F.col("_us").isNotNull().alias("_head"), F.substring("_keep", 1, EXCERPT_CHARS).alias("_text"), size.cast("long").alias("_size"))
    numbered = with_running(sized, ["_session"], "_chunk", ["_line", "_id"], F.col("_head").cast("long"), "_entry")
    numbered = stored(with_running(numbered, ["_session"], "_chunk", ["_line", "_id"], F.col("_size"), "_upto").filter("_entry > 0"), "entries-lines")
    starts = numbered.filter("_head").select("_session", "_entry", F.col("_line").alias("_first"), (F.col("_upto") - F.col("_size")).alias("_from"))
    parts = numbered.join(starts, ["_session", "_entry"]).filter(F.col("_upto") - F.col("_size") - F.col("_from") < EXCERPT_CHARS)
    text = parts.groupBy("_session", "_first").agg(F.array_sort(F.collect_list(F.struct("_line", "_text"))).alias("_t"))
    joined = F.array_join(F.transform("_t", lambda x: x["_text"]), "\n")
    text = text.select(F.col("_session").alias(session), F.col("_first").cast("long").alias("first_line_no"), F.substring(joined, 1, EXCERPT_CHARS).alias("log_excerpt"))
    return out.join(text, [session, "first_line_no"], "left")
