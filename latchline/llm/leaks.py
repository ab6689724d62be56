"""Test passages inside a training corpus, found through a positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latchline.llm.words import common_subsequence, words
from latchline.session import spread, stored

#: Least share of an item's words, and of its rare words, that a document must hold in order in one place.
SHARE, RARE_SHARE = 0.3, 0.2
#: Least share of the rare words of the matched stretch that are matched, and words counted beyond its ends.
CLOSE, EDGE = 0.5, 12
#: A word's commonness is its share of the documents without passages plus its share of the other items, each
#: with so many documents and items added to the count.  Rare words are the least common third of an item's
#: words, all that are as rare as the last of them included, but none commoner than ``STOCK``;
#: in any case the ``LEAST_RARE`` rarest.
RAREST, STOCK, MORE_DOCS, MORE_ITEMS, LEAST_RARE = 1 / 3, 0.01, 1000, 100, 3
#: The index is searched for the rarest words of each of so many parts of an item: a third covers one of them whole.
PARTS, PART_WORDS, PART_LEAST = 6, 4, 3
#: Searched words that a candidate shares with an item at one offset: so many that few items have, or so many of one part, one such among them.
LEAST_SHARED = 2
#: Words by which the offset may wander inside one place (lines between, dropped words).
WANDER = 192
#: Up to so many bytes of test words are sent to each task, which filters its postings itself; beyond, they are joined.
HELD_BYTES = 64 << 20


def _posting_rows(known):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None if known is None else known.value
        for b in batches:
            ids, terms, places = [], [], []
            for doc, text in zip(b["_doc"], b["_text"], strict=True):
                at: dict[str, list[int]] = {}
                for i, w in enumerate(words(text)):
                    if held is None or w in held:
                        at.setdefault(w, []).append(i)
                ids.extend([doc] * len(at))
                terms.extend(at)
                places.extend(at.values())
            if ids:  # an empty frame has no type for the lists
                yield pd.DataFrame({"_doc": ids, "_term": terms, "_places": places})

    return run


def positional_index(docs: DataFrame, vocabulary: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Postings ``(_doc, _term, _places)`` of every document for the words of ``vocabulary``."""
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).filter("_doc is not null and _text is not null")
    rows = spread(rows)
    shape = f"_doc {dict(rows.dtypes)['_doc']}, _term string, _places array<int>"
    size = vocabulary.agg(F.sum(F.octet_length("_term") + F.lit(64))).first()[0] or 0
    if size <= HELD_BYTES:
        known = docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in vocabulary.collect()))
        return rows.mapInPandas(_posting_rows(known), shape)
    return rows.mapInPandas(_posting_rows(None), shape).join(vocabulary, "_term", "left_semi")


def _item_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for i, text in zip(b["_item"], b["_text"], strict=True):
            w = words(text)
            parts = max(1, min(PARTS, len(w) // PART_LEAST))
            out.extend((i, x, n, n * parts // len(w), len(w)) for n, x in enumerate(w))
        if out:
            yield pd.DataFrame(out, columns=["_item", "_term", "_n", "_part", "_length"])


def candidates(index: DataFrame, spots: DataFrame, seen: DataFrame) -> DataFrame:
    """``(_doc, _item)`` where the lists of an item's rarest words agree in their offset.

    The rarest words are taken from each part of the item, so a passage is found by its own
    words, whatever became of the rest of the item: any third of the item covers one part
    whole, and words that the corpus lacks are missing in parts only that nobody copied, or
    were changed one by one.  No frequency is too high.
    """
    terms = spots.groupBy("_item", "_part", "_term").agg(F.sort_array(F.collect_list("_n")).alias("_at"))
    items = spots.groupBy("_term").agg(F.count_distinct("_item").alias("_items"))
    many = spots.select("_item").distinct().count()
    part, item = Window.partitionBy("_item", "_part"), Window.partitionBy("_item")
    ranked = terms.join(seen, "_term", "left").fillna(0, ["_all"]).join(items, "_term")
    ranked = ranked.withColumn("_own", (F.col("_items") - 1) / F.lit(many + MORE_ITEMS) <= STOCK)
    # In an item of shared wording only every word is its own.
    ranked = ranked.withColumn("_own", F.col("_own") | (F.count_if("_own").over(item) < LEAST_RARE))
    ranked = ranked.withColumn("_r", F.row_number().over(part.orderBy("_all", "_term"))).withColumn("_distinct", F.count(F.lit(1)).over(part))
    chosen = ranked.filter((F.col("_r") <= PART_WORDS) & (F.col("_all") > 0)).select("_item", "_part", "_term", "_at", "_own", "_distinct")
    chosen = stored(chosen, "leak-chosen")
    met = index.join(chosen, "_term").select("_doc", "_item", "_part", "_term", "_own", "_distinct", "_at", F.explode("_places").alias("_p"))
    met = met.select("_doc", "_item", "_part", "_term", "_own", "_distinct", "_p", F.explode("_at").alias("_n"))
    # Offsets in overlapping buckets, so that matches a little apart still meet in one of them.
    near = F.floor((F.col("_p") - F.col("_n")) / WANDER).cast("int")
    # One shuffle: a pair's matches lie together for all the groupings below.
    met = met.withColumn("_b", F.explode(F.array(near, near - 1))).drop("_p", "_n", "_at").repartition("_doc", "_item")
    met = met.groupBy("_doc", "_item", "_b", "_part", "_term").agg(F.first("_own").alias("_own"), F.first("_distinct").alias("_distinct"))
    parts = met.groupBy("_doc", "_item", "_b", "_part").agg(F.count(F.lit(1)).alias("_hits"), F.count_if("_own").alias("_own"), F.first("_distinct").alias("_distinct"))
    enough = (F.col("_own") > 0) & (F.col("_hits") >= F.least(F.lit(LEAST_SHARED), F.col("_distinct")))
    places = parts.groupBy("_doc", "_item", "_b").agg(F.max(enough).alias("_enough"), F.sum("_own").alias("_own"))
    return places.filter(F.col("_enough") | (F.col("_own") >= LEAST_SHARED)).select("_doc", "_item").distinct()


def rare_words(spots: DataFrame, seen: DataFrame, held: DataFrame, total: int) -> DataFrame:
    """``(_item, _term, _n, _rare)`` of every word of every item.

    Documents with a passage don't make an item's own names common: a word's document
    frequency leaves out those that hold, with the word, ``SHARE`` of an item that has it.
    """
    leaked = held.filter("_strong").select("_doc", F.explode("_met._term").alias("_term")).distinct().groupBy("_term").agg(F.count(F.lit(1)).alias("_leaked"))
    terms = spots.select("_item", "_term").distinct()
    items = terms.groupBy("_term").agg(F.count(F.lit(1)).alias("_items"))
    many = spots.select("_item").distinct().count()
    clean = items.join(seen, "_term", "left").join(leaked, "_term", "left").fillna(0, ["_all", "_leaked"])
    common = (F.col("_all") - F.col("_leaked")) / F.lit(total + MORE_DOCS) + (F.col("_items") - 1) / F.lit(many + MORE_ITEMS)
    size = Window.partitionBy("_item")
    ranked = terms.join(clean.select("_term", common.alias("_common")), "_term")
    ranked = ranked.withColumn("_r", F.rank().over(size.orderBy("_common"))).withColumn("_most", F.ceil(F.count(F.lit(1)).over(size) * RAREST))
    # An item of stock words only keeps its rarest.
    rare = (F.col("_r") <= LEAST_RARE) | ((F.col("_r") <= F.col("_most")) & (F.col("_common") <= STOCK))
    return spots.join(ranked.select("_item", "_term", rare.alias("_rare")), ["_item", "_term"]).select("_item", "_term", "_n", "_rare")


def _rare_matches(item: list[tuple[int, str]], doc: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """Places (item, document) of a longest common subsequence of rare words."""
    n, m = len(item), len(doc)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, word = best[i], best[i + 1], item[i][1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if word == doc[j][1] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if item[i][1] == doc[j][1]:
            out.append((item[i][0], doc[j][0]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def dense_stretch(rare: list[int], met: list[tuple[int, int]]) -> tuple[int, int]:
    """First and last index of the longest stretch of ``met`` in which ``CLOSE`` of the item's rare words are matched."""
    spot = {n: k for k, n in enumerate(rare)}
    # A stretch is close enough if matched words times (1 - CLOSE) outweigh the others times CLOSE.
    level, rising, best = [], [], (0, 0)
    for k, (n, _) in enumerate(met):
        level.append(k - CLOSE * spot[n])
        if not rising or level[k] < level[rising[-1]]:
            rising.append(k)
    for k in range(len(met) - 1, -1, -1):
        # Matches a..k are k - a + 1, the rare words among them spot[k] - spot[a] + 1.
        while rising and level[k] - level[rising[-1]] + 1 - CLOSE >= 0:
            a = rising.pop()
            if k - a > best[1] - best[0]:
                best = (a, k)
    return best


def shares(item: list[str], rare: list[bool], met: dict[str, list[int]]) -> tuple[float, float, float, int]:
    """Rare share, word share, closeness and longest exact phrase of one candidate in its best place.

    ``met`` are the document's postings of the item's words.  A place is where the rare words'
    offsets agree.  Rare words matched there in order mark stretches of the item; closeness is
    the share of a stretch's rare words that are matched, and of each place the longest stretch
    close enough counts.  Words count around that stretch only, so stock wording elsewhere adds nothing.
    """
    spots: dict[str, list[int]] = {}
    for n, w in enumerate(item):
        spots.setdefault(w, []).append(n)
    rare_item = [(n, w) for n, w in enumerate(item) if rare[n]]
    rare_at = [n for n, _ in rare_item]
    doc = sorted((p, w) for w, places in met.items() for p in places)
    buckets: dict[int, set[int]] = {}
    for k, (p, w) in enumerate(doc):
        for n in spots.get(w, ()):
            if rare[n]:
                b = (p - n) // WANDER
                buckets.setdefault(b, set()).add(k)
                buckets.setdefault(b - 1, set()).add(k)
    best, tried = (0.0, 0.0, 0.0), set()
    for b in sorted(buckets):
        near = sorted(buckets[b])
        if (near[0], near[-1]) in tried:
            continue
        tried.add((near[0], near[-1]))
        chain = _rare_matches(rare_item, [doc[k] for k in near])
        a, z = dense_stretch(rare_at, chain)
        (n1, p1), (n2, p2) = chain[a], chain[z]
        inside = sum(1 for n in rare_at if n1 <= n <= n2)
        part = item[max(0, n1 - EDGE) : n2 + EDGE + 1]
        around = [w for p, w in doc if p1 - EDGE <= p <= p2 + EDGE]
        got = common_subsequence(part, around) / len(item)
        # The place that lies furthest above its thresholds.
        mine = ((z - a + 1) / max(1, len(rare_item)), got, (z - a + 1) / inside)
        if min(mine[0] / RARE_SHARE, mine[1] / SHARE) > min(best[0] / RARE_SHARE, best[1] / SHARE):
            best = mine
    phrase, runs = 0, {}
    for p, w in doc:
        for n in spots.get(w, ()):
            runs[(p, n)] = length = runs.get((p - 1, n - 1), 0) + 1
            phrase = max(phrase, length)
    return (*best, phrase)


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [shares(list(item), list(rare), {m["_term"]: list(m["_places"]) for m in met}) for item, rare, met in zip(b["_words"], b["_rare"], b["_met"], strict=True)]
        columns = {c: [g[k] for g in got] for k, c in enumerate(("rare_share", "word_share", "closeness", "phrase_words"))}
        yield pd.DataFrame({"_doc": b["_doc"], "_item": b["_item"], **columns})


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(doc_id, item_id, word_share, rare_share, closeness, phrase_words)`` of every document that holds a passage of an item.

    Corpus postings of all test words are stored once.  The lists of the rarest words of each
    part of an item, shifted by the word's place in it, are intersected: candidates hold some
    of a part's words at one offset.  The postings of all the item's words in a candidate then
    tell exact phrases and the proximity match: the longest common subsequences of rare words,
    then of all words around the stretch these mark.  No text is read again.

    Null or empty texts hold and are nothing; rows that repeat a doc_id are one document, other
    repeated documents are found each; an item shorter than three words is found only whole;
    empty tables give no rows; extra columns are ignored.
    """
    given = items.select(F.col(item_id).alias("_item"), F.col(text).alias("_text")).filter("_item is not null and _text is not null")
    given = given.dropDuplicates(["_item"])
    spots = stored(given.mapInPandas(_item_rows, f"_item {dict(given.dtypes)['_item']}, _term string, _n int, _part int, _length int"), "leak-items")
    index = stored(positional_index(docs, spots.select("_term").distinct(), doc_id, text), "leak-index")
    total = docs.filter(F.col(text).isNotNull()).count()
    seen = stored(index.groupBy("_term").agg(F.count(F.lit(1)).alias("_all")), "leak-terms")
    # Small beside the index: as a stored table its size is known, so the optimiser broadcasts it only below its threshold.
    pairs = stored(candidates(index, spots, seen), "leak-candidates")
    terms = stored(spots.groupBy("_item", "_term").agg(F.count(F.lit(1)).alias("_times"), F.first("_length").alias("_length")), "leak-item-terms")
    postings = index.join(pairs, "_doc").join(terms, ["_item", "_term"])
    # Rows with one doc_id are one document: the first row's places of a word stand for it.
    met = postings.groupBy("_doc", "_item").agg(
        F.collect_list(F.struct("_term", "_places")).alias("_met"), (F.sum(F.least(F.size("_places"), "_times")) >= F.first("_length") * SHARE).alias("_strong")
    )
    held = stored(met, "leak-postings")
    marked = rare_words(spots, seen, held, total)
    whole = marked.groupBy("_item").agg(F.array_sort(F.collect_list(F.struct("_n", "_term", "_rare"))).alias("_w"))
    whole = stored(whole.select("_item", F.col("_w._term").alias("_words"), F.col("_w._rare").alias("_rare")), "leak-words")
    # Fewer shared words than SHARE, in any order, can't be a passage.
    full = held.filter("_strong").join(whole, "_item")
    kinds = dict(full.dtypes)
    checked = full.select("_doc", "_item", "_met", "_words", "_rare").mapInPandas(
        _verify, f"_doc {kinds['_doc']}, _item {kinds['_item']}, rare_share double, word_share double, closeness double, phrase_words int"
    )
    found = checked.filter((F.col("word_share") >= SHARE) & (F.col("rare_share") >= RARE_SHARE) & (F.col("closeness") >= CLOSE))
    return found.select(F.col("_doc").alias(doc_id), F.col("_item").alias(item_id), "word_share", "rare_share", "closeness", "phrase_words")
