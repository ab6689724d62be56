"""Language of documents and of their lines, with labels checked against it."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latchline.llm.langid import LANGUAGES, LanguageModel, is_prose, label_language, natural_words
from latchline.session import spread, stored
from latchline.tables import broadcast_if_small

#: Labelled documents the classifier is fitted on, at most, and characters of each; everything is classified whole.
TRAIN_ROWS, TRAIN_CHARS = 4000, 4000


def fit(docs: DataFrame, doc_id: str, text: str, lang: str, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> LanguageModel:
    """Trains on about ``rows`` documents (at most twice as many) whose label names one of the languages, chosen by a hash of the id."""
    # Labels are read once each: their distinct spellings are written out before Python sees them.
    labels = stored(docs.select(F.col(lang).alias("_l")).filter("_l is not null").distinct(), "language-labels")
    good = broadcast_if_small(stored(labels.mapInPandas(_named, f"_l {dict(labels.dtypes)['_l']}"), "language-named"))
    # A share of all hashes that holds about ``rows`` documents, counted without their texts: no task sends more than its part of the sample.
    many = docs.select(F.col(lang).alias("_l")).join(good, "_l", "left_semi").count()
    share = min(1.0, rows / max(1, many))
    pool = docs.filter(F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)) < int(share * (1 << 30)))
    pool = pool.select(F.col(lang).alias("_l"), F.substring(F.col(text), 1, chars).alias("_t")).filter("_t is not null and _t <> ''")
    sample = pool.join(good, "_l", "left_semi").limit(2 * rows).collect()
    return LanguageModel.trained([(label_language(r["_l"]), r["_t"]) for r in sample])


def _named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b[[label_language(x) in LANGUAGES for x in b["_l"]]]


_models: dict[int, LanguageModel] = {}


def _model(packed) -> LanguageModel:
    """The broadcast model, unpacked once per worker."""
    key = id(packed) if not hasattr(packed, "id") else packed.id
    if key not in _models:
        _models.clear()
        _models[key] = pickle.loads(packed.value)
    return _models[key]


def _read(packed):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(packed)
        names: dict[str | None, str | None] = {}
        for b in batches:
            out = []
            texts = [t if isinstance(t, str) else "" for t in b["_text"]]
            for doc, label, lines in zip(b["_doc"], b["_label"], model.label(texts), strict=True):
                if not lines:
                    continue
                if label not in names:
                    names[label] = label_language(label)
                named, held = names[label], {x[1] for x in lines}
                wrong = named is None or named not in held
                out.extend((doc, n, code, sure, named, wrong, len(held)) for n, code, sure in lines)
            if out:
                yield pd.DataFrame(out, columns=["_doc", "line_no", "seg_lang", "confidence", "named", "mislabelled", "languages"])

    return run


def _read_spans(packed):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(packed)
        for b in batches:
            out = []
            for doc, text in zip(b["_doc"], b["_text"], strict=True):
                lines = [(n, w) for n, w in ((n, natural_words(x)) for n, x in enumerate((text or "").split("\n"))) if is_prose(w)]
                for (n, words), (_, _, spans) in zip(lines, model.spans([w for _, w in lines]), strict=True):
                    out.extend((doc, n, k, a, e, code, model.certainty(words[a:e], code), " ".join(words[a:e])) for k, (a, e, code) in enumerate(spans))
            if out:
                yield pd.DataFrame(out, columns=["_doc", "line_no", "span_no", "first_word", "end_word", "seg_lang", "confidence", "span_words"])

    return run


def _prepared(docs: DataFrame, doc_id: str, text: str, lang: str, model: LanguageModel | None):
    model = model or fit(docs, doc_id, text, lang)
    # Size bounded by the sample: distinct words of TRAIN_ROWS documents.
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(lang).alias("_label"), F.col(text).alias("_text"))
    return packed, spread(rows), dict(rows.dtypes)["_doc"]


def line_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: LanguageModel | None = None) -> DataFrame:
    """One row per line of prose: ``doc_id, line_no, seg_lang, confidence, named, mislabelled, languages``.

    ``named`` is what the document's label means ('?' for another language, null for
    none); ``mislabelled`` tells that it names no language or one that no line has;
    ``languages`` counts those of the lines.

    The script of a word narrows its languages; per-word scores and a penalty for
    switching give the language of each stretch (Viterbi), a line has that of most of
    its words.  Blank lines and lines of log output, code, rules or figures alone have
    no row; null and empty texts have none; repeated documents are read each; without
    labelled documents the model rests on function words; empty tables give no rows;
    extra columns are ignored.
    """
    packed, rows, kind = _prepared(docs, doc_id, text, lang, model)
    shape = f"_doc {kind}, line_no bigint, seg_lang string, confidence double, named string, mislabelled boolean, languages int"
    return rows.mapInPandas(_read(packed), shape).withColumnRenamed("_doc", doc_id)


def language_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: LanguageModel | None = None) -> DataFrame:
    """The stretches of one language inside every line of prose, counted in its natural words, each with its language's confidence among all."""
    packed, rows, kind = _prepared(docs, doc_id, text, lang, model)
    shape = f"_doc {kind}, line_no bigint, span_no int, first_word int, end_word int, seg_lang string, confidence double, span_words string"
    return rows.mapInPandas(_read_spans(packed), shape).withColumnRenamed("_doc", doc_id)


def document_languages(lines: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Main language of each document: that of most lines of prose, with the mean confidence of those lines."""
    votes = lines.groupBy(doc_id, "seg_lang").agg(F.count(F.lit(1)).alias("_n"), F.sum("confidence").alias("_sum"))
    best = votes.groupBy(doc_id).agg(F.max(F.struct("_n", "_sum", "seg_lang")).alias("_b"), F.sum("_n").alias("_all"))
    return best.select(doc_id, F.col("_b.seg_lang").alias("doc_lang"), (F.col("_b._sum") / F.col("_all")).alias("confidence"), F.col("_all").alias("prose_lines"))
