"""Mixing sources to target shares of the total size in tokens."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latchline.session import spread, stored
from latchline.tables import broadcast_if_small

#: Where the public vocabularies lie; a parameter of every operator that needs one.
VOCABULARY = os.environ.get("LATCHLINE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Splitting pattern that belongs to that vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Bits of the hash that make a bucket, at each of the two levels.
BITS = 12
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a ``.tiktoken`` vocabulary, once per worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def shipped(spark: SparkSession, path: str) -> str:
    """Sends the vocabulary along with the job and returns its name there, so workers need no file of their own."""
    if (sent := getattr(spark.sparkContext, "_latchline_files", None)) is None:
        sent = spark.sparkContext._latchline_files = set()
    if path not in sent:
        spark.sparkContext.addFile(path)
        sent.add(path)
    return os.path.basename(path)


def token_counts(name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(SparkFiles.get(name))
        for b in batches:
            out = b.drop(columns="_text")
            out["_tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in b["_text"]]
            yield out

    return run


def with_tokens(docs: DataFrame, row_id: str, source: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``_id, _source, _tokens``: sizes of whole texts; a null or empty text has none."""
    rows = docs.select(F.col(row_id).alias("_id"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    kinds = dict(rows.dtypes)
    return spread(rows).mapInPandas(token_counts(shipped(docs.sparkSession, vocabulary)), f"_id {kinds['_id']}, _source {kinds['_source']}, _tokens bigint")


def _threshold(counts: DataFrame, wanted: DataFrame, by: Column) -> DataFrame:
    """Per source the bucket in which the running sum crosses what is ``_wanted``, and the sum before it."""
    sums = counts.withColumn("_bucket", by).groupBy("_source", "_bucket").agg(F.sum("_tokens").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sums.withColumn("_upto", F.sum("_sum").over(before)).join(wanted, "_source")
    crossed = running.filter(F.col("_upto") > F.col("_wanted"))
    return crossed.groupBy("_source").agg(
        F.min("_bucket").alias("_bucket"),
        F.min_by(F.col("_wanted") - (F.col("_upto") - F.col("_sum")), "_bucket").alias("_wanted"),
    )


def mixture(
    docs: DataFrame,
    targets: DataFrame,
    row_id: str,
    source: str,
    text: str,
    total_tokens: int | None = None,
    vocabulary: str = VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """``(chosen, shares)`` of a mixture of ``total_tokens`` (the size of all targeted sources by default).

    ``targets``: ``source, target_share, max_repeats``.  A source first repeats as a
    whole, then adds the documents whose hash lies below a threshold.  Thresholds come
    from token sums by source and hash bucket; only the boundary bucket is refined, and
    nothing is sorted.  A source that is too small gives ``max_repeats`` copies of all
    it has; the shares really reached are reported.

    ``chosen``: ``doc_id, source, copies, tokens``; ``shares``: one row per target.
    Rows with one id are rows each, and each is chosen or not for itself.
    Documents of no targeted source (null too) are left out; empty texts have size 0
    and go with their hash; repeated texts count like others; an empty corpus gives
    shares of null; a null share or cap counts as 0.
    """
    rules = targets.groupBy(F.col(source).alias("_source")).agg(
        F.coalesce(F.max("target_share"), F.lit(0.0)).alias("_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).cast("long").alias("_cap")
    )
    rules = broadcast_if_small(rules.filter("_source is not null"))
    sized = with_tokens(docs, row_id, source, text, vocabulary).join(rules.select("_source"), "_source", "left_semi")
    # Tokens are counted once and kept, three narrow columns, for the passes below.
    sized = stored(sized.withColumn("_hash", F.shiftrightunsigned(F.xxhash64("_id"), 64 - 2 * BITS - 16)), "mixture")
    sizes = sized.groupBy("_source").agg(F.sum("_tokens").alias("_size"), F.count(F.lit(1)).alias("_docs"))
    total = F.lit(total_tokens).cast("long") if total_tokens is not None else F.sum("_size").over(Window.partitionBy())
    plan = rules.join(sizes, "_source", "left").fillna(0, ["_size", "_docs"])
    plan = plan.withColumn("_goal", F.floor(F.col("_share") * total).cast("long"))
    plan = plan.withColumn("_whole", F.when(F.col("_size") > 0, F.least(F.col("_cap"), F.floor(F.col("_goal") / F.col("_size")))).otherwise(F.least(F.col("_cap"), F.lit(1))).cast("long"))
    plan = plan.withColumn("_rest", F.when(F.col("_whole") < F.col("_cap"), F.col("_goal") - F.col("_whole") * F.col("_size")).otherwise(F.lit(0)))
    # One row per target: bounded by the rules above, and small enough to keep.
    plan = stored(plan, "mixture-plan")
    first = F.shiftrightunsigned("_hash", BITS + 16)
    second = F.shiftrightunsigned("_hash", 16).bitwiseAND((1 << BITS) - 1)
    wanted = plan.select("_source", F.col("_rest").alias("_wanted"))
    one = broadcast_if_small(stored(_threshold(sized, wanted, first), "mixture-one"))
    edge = sized.join(one.select("_source", F.col("_bucket").alias("_b1")), "_source").filter(first == F.col("_b1")).drop("_b1")
    two = broadcast_if_small(stored(_threshold(edge, one.select("_source", "_wanted"), second), "mixture-two"))
    # Inside the boundary bucket of the boundary bucket a running sum decides, document by document.
    last = edge.join(two.select("_source", F.col("_bucket").alias("_b2"), "_wanted"), "_source").filter(second == F.col("_b2"))
    run = Window.partitionBy("_source").orderBy("_hash", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = last.withColumn("_upto", F.sum("_tokens").over(run)).select("_id", "_source", "_tokens", (F.col("_upto") <= F.col("_wanted")).alias("_below"))
    # All other documents are decided by their bucket alone; no row is looked up by its id.
    marked = sized.join(one.select("_source", F.col("_bucket").alias("_b1")), "_source", "left").join(two.select("_source", F.col("_bucket").alias("_b2")), "_source", "left")
    marked = marked.filter(~F.coalesce((first == F.col("_b1")) & (second == F.col("_b2")), F.lit(False)))
    # No crossing in a histogram: the rest takes all there is.
    under = F.col("_b1").isNull() | (first < F.col("_b1")) | ((first == F.col("_b1")) & (F.col("_b2").isNull() | (second < F.col("_b2"))))
    decided = marked.select("_id", "_source", "_tokens", under.alias("_below")).unionByName(tail)
    decided = decided.join(broadcast_if_small(plan.select("_source", "_whole", "_rest")), "_source")
    chosen = decided.withColumn("copies", (F.col("_whole") + ((F.col("_rest") > 0) & F.col("_below")).cast("long")).cast("long")).filter("copies > 0")
    chosen = chosen.select(F.col("_id").alias(row_id), F.col("_source").alias(source), "copies", F.col("_tokens").alias("tokens"))
    used = chosen.groupBy(F.col(source).alias("_source")).agg(F.sum(F.col("copies") * F.col("tokens")).alias("_used"), F.max("copies").alias("_most"))
    whole = F.sum("tokens_used").over(Window.partitionBy())
    shares = (
        plan.join(used, "_source", "left")
        .select(
            F.col("_source").alias(source),
            F.col("_share").alias("target_share"),
            F.col("_cap").alias("max_repeats"),
            F.col("_docs").alias("documents"),
            F.col("_size").alias("tokens_available"),
            F.col("_goal").alias("tokens_wanted"),
            F.coalesce("_used", F.lit(0)).alias("tokens_used"),
            F.coalesce("_most", F.lit(0)).alias("most_copies"),
        )
        .withColumn("actual_share", F.try_divide(F.col("tokens_used").cast("double"), whole))
    )
    return chosen, shares
