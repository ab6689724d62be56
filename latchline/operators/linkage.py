"""Linking logged names to indexed functions, and the call graph of the index."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latchline.functions.units import bare_name, name_tokens, token_overlap
from latchline.operators.text_rules import fits_hints, path_hints
from latchline.tables import broadcast_if_small

# Least similarity of spellings and of token sets; depth of caller chains; direct callers listed.
FUZZY, OVERLAP, DEPTH, CALLERS = 0.85, 0.52, 5, 5


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


# Prefixes that symbols and files of one protocol have, and what each degree of likeness scores; a header loses one.
SYMBOL_PREFIX, FILE_PREFIX = "^(dissect|tcp|diameter|gtpv[12])_+", "^packet-"
NAMED_ALIKE, ALL_PARTS, SOME_PART, HEADER = 3, 2, 1, -1


def canonical_score(name: Column, path: Column) -> Column:
    """How much a file looks like the place where a symbol of this name belongs: by how many of the symbol's parts its name has."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(name), SYMBOL_PREFIX, ""), "[^a-z0-9]+"), lambda x: F.length(x) > 1)
    stem = F.regexp_replace(F.regexp_extract(F.lower(path), r"([^/]*?)(\.[^./]*)?$", 1), FILE_PREFIX, "")
    held = F.size(F.filter(parts, lambda t: stem.contains(t)))
    alike = stem.isin(F.array_join(parts, "_"), F.coalesce(F.get(parts, F.lit(0)), F.lit("")))
    degree = F.when(held < F.size(parts), F.when(F.exists(parts, lambda t: F.lower(path).contains(t)), SOME_PART).otherwise(0)).otherwise(F.when(alike, NAMED_ALIKE).otherwise(ALL_PARTS))
    return F.when(F.size(parts) == 0, 0).otherwise(degree + F.when(path.endswith(".h"), HEADER).otherwise(0))


def match_names(names: DataFrame, index: DataFrame, fuzzy: float = FUZZY, overlap: float = OVERLAP) -> DataFrame:
    """The best indexed function of each distinct ``(app_name, name)``: exact, else normalised, else fuzzy, else by tokens.

    ``index``: ``app_name, id, function_name, file_path, line_number``.  Each stage sees
    only what the earlier ones left; the fuzzy stages compare names of one app that share a
    letter pair or a token, not all pairs.  Ties go by canonical file, path, line and name.
    Names without a match come out with a null method; a null app or name matches nothing.
    """
    wanted = names.select("app_name", "name").distinct()
    f = index.select("app_name", F.col("id").alias("function_id"), "function_name", "file_path", "line_number", bare_name(F.col("function_name")).alias("_bare"))
    f = broadcast_if_small(f)

    def best(hits: DataFrame, method: str, score: Column) -> DataFrame:
        order = [F.desc("_score"), F.desc(canonical_score(F.col("name"), F.col("file_path"))), "file_path", "line_number", "function_name"]
        ranked = hits.withColumn("_score", score).withColumn("_r", F.row_number().over(Window.partitionBy("app_name", "name").orderBy(*order))).filter("_r = 1")
        return ranked.select("app_name", "name", "function_id", F.lit(method).alias("match_method"), F.col("_score").cast("double").alias("match_score"))

    exact = best(wanted.join(f, (wanted["app_name"] == f["app_name"]) & (wanted["name"] == f["function_name"])).drop(f["app_name"]), "exact", F.lit(1.0))
    left = wanted.join(exact, ["app_name", "name"], "left_anti").withColumn("_bare", bare_name(F.col("name")))
    near = best(left.join(f, ["app_name", "_bare"]), "normalised", F.lit(1.0))
    left = left.join(near, ["app_name", "name"], "left_anti")
    # A similarity of fuzzy or more needs common letter pairs: those are the blocking keys.
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    a = left.withColumn("_g", F.explode(pairs(F.col("_bare"))))
    b = f.select("app_name", "function_id", F.col("_bare").alias("_fbare"), F.explode(pairs(F.col("_bare"))).alias("_g"))
    met = a.join(b, ["app_name", "_g"]).select("app_name", "name", "_bare", "function_id", "_fbare").distinct()
    # The ratio can't exceed what the lengths allow.
    met = met.filter(2.0 * F.least(F.length("_bare"), F.length("_fbare")) / (F.length("_bare") + F.length("_fbare")) >= fuzzy)
    scored = met.withColumn("_sim", similarity("_bare", "_fbare")).filter(F.col("_sim") >= fuzzy)
    close = best(scored.join(f.drop("_bare"), ["app_name", "function_id"]), "fuzzy", F.col("_sim"))
    left = left.join(close, ["app_name", "name"], "left_anti")
    # Labels of a protocol family are compared with the functions of its files, if the app has any.
    hinted = left.withColumn("_hints", path_hints(F.col("name")))
    fitting = hinted.filter("_hints is not null").join(f.select("app_name", "file_path"), "app_name").filter(fits_hints(F.col("file_path"), F.col("_hints"))).select("app_name", "name").distinct()
    hinted = hinted.join(fitting.withColumn("_fit", F.lit(True)), ["app_name", "name"], "left").withColumn("_hints", F.when(F.col("_fit"), F.col("_hints"))).drop("_fit")
    ta = hinted.withColumn("_ta", name_tokens(F.col("name")))
    tb = f.select("app_name", "function_id", "file_path", name_tokens(F.col("function_name")).alias("_tb"))
    shared = ta.select("app_name", "name", "_ta", "_hints", F.explode("_ta").alias("_g")).join(tb.select("app_name", "function_id", "file_path", "_tb", F.explode("_tb").alias("_g")), ["app_name", "_g"])
    shared = shared.filter(fits_hints(F.col("file_path"), F.col("_hints")))
    shared = shared.select("app_name", "name", "_ta", "function_id", "_tb").distinct().withColumn("_sim", token_overlap(F.col("_ta"), F.col("_tb"))).filter(F.col("_sim") >= overlap)
    tokens = best(shared.join(f.drop("_bare"), ["app_name", "function_id"]), "tokens", F.col("_sim"))
    found = exact.unionByName(near).unionByName(close).unionByName(tokens)
    return wanted.join(found, ["app_name", "name"], "left")


def match_calls(calls: DataFrame, sessions: DataFrame, index: DataFrame) -> DataFrame:
    """Matches of distinct logged names, brought back to every call (a join on the few names)."""
    s = sessions.select(F.col("id").alias("session_id"), "app_name")
    named = calls.withColumnRenamed("function_name", "name").join(s, "session_id")
    return named.join(match_names(named, index), ["app_name", "name"], "left")


def text_matches(texts: DataFrame, strings: DataFrame, fuzzy: float = FUZZY) -> DataFrame:
    """``(text_id, string_id, confidence)``: log texts linked to the source's log strings.

    ``texts``: ``text_id, line_no, line``; ``strings``: ``string_id, log_string``.  The first line that
    equals a string counts 1.0; otherwise the most similar string of five or more characters sharing a
    word with a line.
    """
    lines = texts.filter("line is not null and trim(line) <> ''").select("text_id", "line_no", F.trim("line").alias("line"))
    s = broadcast_if_small(strings.filter("log_string is not null").select("string_id", F.trim("log_string").alias("log_string")))
    exact = lines.join(s, F.col("line") == F.col("log_string")).groupBy("text_id").agg(F.min(F.struct("line_no", "string_id"))["string_id"].alias("string_id")).withColumn("confidence", F.lit(1.0))
    left = lines.join(exact, "text_id", "left_anti").filter(F.length("line") >= 5)
    parts = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: F.length(x) > 2))
    met = left.withColumn("_g", F.explode(parts(F.col("line")))).join(s.withColumn("_g", F.explode(parts(F.col("log_string")))), "_g").select("text_id", "line", "string_id", "log_string").distinct()
    scored = met.withColumn("confidence", similarity(F.lower("line"), F.lower("log_string"))).filter(F.col("confidence") >= fuzzy)
    close = scored.groupBy("text_id").agg(F.max(F.struct("confidence", (-F.col("string_id")).alias("_o"), "string_id")).alias("_b")).select("text_id", "_b.string_id", "_b.confidence")
    return exact.unionByName(close)


# What step names begin with that no function does, the shortest name looked for, and confidences.
STEP_PREFIX, LEAST_TERM, IN_NAME, IN_PATH = "^(run |step |execute )+", 3, 0.5, 0.3


def step_matches(steps: DataFrame, index: DataFrame) -> DataFrame:
    """``step_name, function_id, confidence`` of each distinct step name: the first function whose name holds it (0.5), else whose path does (0.3).

    A name is looked up by its first three characters among all runs of three that names and
    paths hold, so only functions that may hold it are compared.  Null names are left out;
    names without a match have nulls.
    """
    terms = steps.select("step_name").filter("step_name is not null").distinct().withColumn("_t", F.regexp_replace(F.lower("step_name"), STEP_PREFIX, ""))
    sought = terms.filter(F.length("_t") >= LEAST_TERM).withColumn("_g", F.substring("_t", 1, LEAST_TERM))

    def holding(column: str, score: float) -> DataFrame:
        text = F.lower(F.col(column))
        f = index.select(F.col("id").alias("function_id"), text.alias("_x")).filter(F.length("_x") >= LEAST_TERM)
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_x") - LEAST_TERM + 1), lambda i: F.substring(F.col("_x"), i, F.lit(LEAST_TERM))))
        met = sought.join(f.withColumn("_g", F.explode(grams)), "_g").filter(F.col("_x").contains(F.col("_t")))
        return met.groupBy("step_name").agg(F.min("function_id").alias("function_id")).withColumn("confidence", F.lit(score))

    named = holding("function_name", IN_NAME)
    placed = holding("file_path", IN_PATH).join(named, "step_name", "left_anti")
    return terms.select("step_name").join(named.unionByName(placed), "step_name", "left")


def call_edges(index: DataFrame) -> DataFrame:
    """Distinct ``(app_name, caller, callee)`` between functions of the index; unreadable lists give no edges."""
    f = index.select("app_name", F.col("function_name").alias("caller"), F.explode(F.from_json("calls_json", "array<string>")).alias("callee"))
    known = index.select("app_name", F.col("function_name").alias("callee")).distinct()
    return f.join(known, ["app_name", "callee"], "left_semi").select("app_name", "caller", "callee").distinct()


def direct_callers(index: DataFrame, most: int = CALLERS) -> DataFrame:
    """Up to ``most`` callers of each function, in order of their names, and how many there are."""
    rank = Window.partitionBy("app_name", "callee").orderBy("caller")
    e = call_edges(index)
    top = e.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= most)
    n = e.groupBy("app_name", "callee").agg(F.count(F.lit(1)).alias("callers_n"))
    return top.groupBy("app_name", "callee").agg(F.array_join(F.sort_array(F.collect_list("caller")), ",").alias("callers")).join(n, ["app_name", "callee"])


def caller_closure(index: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(app_name, function_name, caller, min_depth)``: who reaches a function within ``depth`` calls, itself left out."""
    e = call_edges(index)
    found = e.select("app_name", F.col("callee").alias("function_name"), "caller").filter("caller <> function_name").withColumn("min_depth", F.lit(1))
    front = found
    up = e.select("app_name", F.col("callee").alias("_at"), F.col("caller").alias("_next"))
    for d in range(2, depth + 1):
        step = front.join(up, (front["app_name"] == up["app_name"]) & (front["caller"] == up["_at"])).select(front["app_name"], "function_name", F.col("_next").alias("caller")).distinct()
        front = step.filter("caller <> function_name").join(found, ["app_name", "function_name", "caller"], "left_anti").withColumn("min_depth", F.lit(d))
        found = found.unionByName(front)
    return found


def enclosing_function(places: DataFrame, index: DataFrame) -> DataFrame:
    """For ``(place_id, app_name, file_path, line)`` the first function whose lines contain it (a range join per file)."""
    f = index.select("app_name", "file_path", F.col("id").alias("function_id"), "line_number", "end_line_number")
    hit = places.join(f, ["app_name", "file_path"], "left").filter(F.col("function_id").isNull() | ((F.col("line") >= F.col("line_number")) & (F.col("line") <= F.col("end_line_number"))))
    first = hit.groupBy("place_id").agg(F.min(F.struct("line_number", "function_id"))["function_id"].alias("function_id"))
    return places.select("place_id").join(first, "place_id", "left")
