import os

import pytest

from latchline.llm import mixture as mx
from latchline.llm.mixture import mixture

pytestmark = pytest.mark.skipif(not os.path.exists(mx.VOCABULARY), reason="no vocabulary")
TARGETS = "source string, target_share double, max_repeats int, tokens string"


def docs(spark, sizes):
    rows, i = [], 0
    for source, n, words in sizes:
        for _ in range(n):
            rows.append((i, source, "word " * words, "x"))
            i += 1
    rows += [(i, "a", "", "x"), (i + 1, "a", None, "x"), (i + 2, None, "word word", "x"), (i + 3, "unwanted", "word", "x")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, copies string")


def test_shares_caps_and_tokens(spark):
    d = docs(spark, [("a", 600, 20), ("b", 300, 7), ("c", 10, 5)])
    t = spark.createDataFrame([("a", 0.5, 1, "x"), ("b", 0.4, 4, "x"), ("c", 0.1, 2, "x"), ("absent", 0.0, 3, "x")], TARGETS)
    chosen, shares = mixture(d, t, "doc_id", "source", "text")
    rows = {r["source"]: r for r in shares.collect()}
    enc = mx.encoder(mx.VOCABULARY)
    size = {s: n * len(enc.encode_ordinary("word " * w)) for s, n, w in (("a", 600, 20), ("b", 300, 7), ("c", 10, 5))}
    total = sum(size.values())
    assert {s: rows[s]["tokens_available"] for s in size} == size
    for s, share in (("a", 0.5), ("b", 0.4)):
        assert 0 <= share * total - rows[s]["tokens_used"] <= 40
    assert rows["c"]["tokens_used"] == 2 * size["c"] and rows["c"]["most_copies"] == 2
    assert rows["absent"]["tokens_used"] == 0
    used = sum(r["tokens_used"] for r in rows.values())
    assert all(abs(r["actual_share"] - r["tokens_used"] / used) < 1e-9 for r in rows.values())
    got = chosen.collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    assert {r["source"] for r in got} == {"a", "b", "c"}
    assert max(r["copies"] for r in got if r["source"] == "b") <= 4


def test_nested_budgets(spark):
    d = docs(spark, [("a", 400, 9), ("b", 400, 3)])
    t = spark.createDataFrame([("a", 0.5, 1, "x"), ("b", 0.5, 1, "x")], TARGETS)
    few, more = ({r["doc_id"] for r in mixture(d, t, "doc_id", "source", "text", total_tokens=n)[0].filter("tokens > 0").collect()} for n in (800, 1600))
    assert few < more


def test_empty_corpus(spark):
    t = spark.createDataFrame([("a", 1.0, 1, "x")], TARGETS)
    chosen, shares = mixture(docs(spark, []).limit(0), t, "doc_id", "source", "text")
    assert chosen.count() == 0
    assert [(r["tokens_used"], r["actual_share"]) for r in shares.collect()] == [(0, None)]


def test_rows_with_one_id_are_rows_each(spark):
    d = docs(spark, [("a", 300, 9), ("b", 300, 3)])
    t = spark.createDataFrame([("a", 0.5, 1, "x"), ("b", 0.5, 1, "x")], TARGETS)
    chosen, shares = mixture(d.union(d), t, "doc_id", "source", "text", total_tokens=1000)
    used = {r["source"]: r for r in shares.collect()}
    assert all(490 <= used[s]["tokens_used"] <= 500 for s in "ab")
    assert sum(r["tokens"] * r["copies"] for r in chosen.collect()) == sum(r["tokens_used"] for r in used.values())


def test_whole_texts_are_counted(spark):
    text = "one two three four\n" * 20_000 + "x" * 100_000
    d = spark.createDataFrame([(1, "a", text)], "doc_id long, source string, text string")
    (row,) = mx.with_tokens(d, "doc_id", "source", "text").collect()
    assert row["_tokens"] == len(mx.encoder(mx.VOCABULARY).encode_ordinary(text))
