import random

import pytest

from latchline.llm.leaks import leaked_items, shares
from latchline.llm.words import common_subsequence, normal, words

RND = random.Random(4)
NAME = lambda: "".join(RND.choice(["Ba", "Ko", "Ri", "Mu", "Te", "Lo"]) + RND.choice("nrstl") for _ in range(3)).capitalize()
ITEMS = [(k, " ".join(f"Suppose that operator {NAME()} holds {RND.randrange(1000, 9999)} open handles near {NAME()}, although {NAME()} forgot its lease." for _ in range(5)), "x") for k in range(12)]
FILL = "The nightly build was slowed down by the shared pool and the team agreed to watch it. "


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_subsequence_like_table():
    for _ in range(200):
        a, b = ([RND.randrange(5) for _ in range(RND.randrange(12))] for _ in range(2))
        assert common_subsequence(a, b) == lcs(a, b)


def test_variants_read_alike():
    plain = words("Ravuno holds 1234 cafe units")
    for text in ("RAVUNO  holds １２３４ café units", "Rav​uno\xa0holds “1234” cafe units", "Rаvunо holds 1234 cafe units", "Ra­vuno holds 1234 caf\\u00e9\\nunits", "Ravuno holds 1234 ca-\n> fe units", "Ravuno holds 1234 caf&#233; units"):
        assert words(text) == plain, text
    assert words(None) == words("") == [] and normal("ß") == "ss" and words("自分 ok") == ["自", "分", "ok"]


def variants(text):
    w = text.split()
    third = w[len(w) // 4 : len(w) // 4 + len(w) // 2]
    noisy = [RND.choice(["indeed", x, x, x, x, x, x, x, x]) for x in w]
    lines = [" ".join(w[i : i + 8]) for i in range(0, len(w), 8)]
    return [text, text.upper(), " ".join(third), " ".join(noisy), "\n".join("> " + x for x in lines), "\n".join("[worker-1] " + x for x in lines), text.replace(" ", "  ").replace("o", "o​")]


def test_passages_found_and_stock_wording_not(spark):
    rows, want = [], set()
    for k, text, _ in ITEMS:
        for v in variants(text):
            want.add((len(rows), k))
            rows.append((len(rows), FILL * 3 + "\n" + v + "\n" + FILL * 2, k))
    for k in range(60):
        decoy = " ".join(f"Suppose that operator {NAME()} holds {RND.randrange(1000, 9999)} open handles near {NAME()}, although {NAME()} forgot its lease." for _ in range(5))
        rows.append((len(rows), FILL + decoy, k))
        rows.append((len(rows), FILL + " ".join(ITEMS[k % 12][1].split()[:8]), k))
    rows += [(len(rows), FILL * 5, None) for _ in range(1500)]
    rows += [(90001, None, 1), (90002, "", 1), (None, ITEMS[0][1], 1), (90003, "x" * 300_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    items = spark.createDataFrame([*ITEMS, (98, None, "x"), (99, "", "x")], "item_id long, text string, word_share string")
    got = {(r["doc_id"], r["item_id"]) for r in leaked_items(docs, items).collect()}
    assert got == want
    assert leaked_items(docs.limit(0), items).count() == 0
    assert leaked_items(docs.limit(20), items.limit(0)).count() == 0


def test_partial_passages_of_a_widely_leaked_item_found(spark):
    item = ITEMS[0][1].split()
    third = len(item) // 3 + 2
    rows = [(n, FILL + ITEMS[0][1]) for n in range(600)]
    rows += [(1000 + n, FILL + " ".join(item[at : at + third])) for n, at in enumerate(range(0, len(item) - third, 4))]
    rows += [(2000 + n, FILL + " ".join(item[:third])) for n in range(300)]
    want = {(n, 0) for n, _ in rows}
    rows += [(5000 + n, FILL * 4) for n in range(1200)]
    got = leaked_items(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string, suite string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


@pytest.mark.parametrize("size", [200, 1500, 6000])
def test_lone_parts_found_at_every_corpus_size(spark, size):
    """Any third or more of an item that is nowhere whole, in one document or in 5 % of them."""
    rows = [(n, FILL * 3) for n in range(size)]
    want = set()
    for k, (_, text, _) in enumerate(ITEMS[:8]):
        w = text.split()
        third = len(w) // 3 + 2
        at = (k * len(w)) // 12  # another part of each item
        part = " ".join(w[min(at, len(w) - third) :][:third])
        for _ in range(1 if k % 2 else size // 20):
            want.add((len(rows), k))
            rows.append((len(rows), FILL + part + "\n" + FILL))
    # Half of one item, two thirds of it elsewhere, its rest never.
    w = ITEMS[9][1].split()
    for part in (w[: len(w) // 2], w[len(w) // 3 :], w[5 : 5 + len(w) // 3 + 2]):
        want.add((len(rows), 9))
        rows.append((len(rows), " ".join(part)))
    got = leaked_items(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string, suite string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.select("doc_id", "item_id").collect()} == want


def test_a_stray_later_name_hides_nothing():
    item = [f"n{k}" if k % 3 == 0 else "the" for k in range(72)]
    doc = [*item[:24], *["line"] * 30, "n69"]
    met = {}
    for p, w in enumerate(doc):
        met.setdefault(w, []).append(p)
    rare_share, word_share, closeness, phrase = shares(item, [w != "the" for w in item], met)
    assert rare_share == 8 / 24 and word_share >= 1 / 3 and closeness == 1 and phrase == 24


def test_recall_against_all_pairs(spark):
    """Every tenth stored document against every item, word by word."""
    root = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "eval_items"))
    got = {(r["doc_id"], r["item_id"]) for r in leaked_items(docs, items).filter("doc_id % 10 = 0").collect()}
    texts = {r["item_id"]: words(r["text"]) for r in items.collect()}
    near = set()
    for r in docs.filter("doc_id % 10 = 0").collect():
        d = words(r["text"])
        near |= {(r["doc_id"], i) for i, w in texts.items() if common_subsequence(w, d) >= 0.55 * len(w)}
    assert near and got >= near
