import random

import pytest

from latchline.llm.langid import LANGUAGES, LanguageModel, is_prose, label_language, natural_words
from latchline.llm.languages import document_languages, fit, language_spans, line_languages
from latchline.tables import table

SPEECH = {
    "en": "the build was slow and the team agreed to watch it for a week",
    "de": "der Lauf war langsam und das Team will ihn eine Woche beobachten",
    "fr": "la compilation était lente et l'équipe va la surveiller une semaine",
    "es": "la compilación fue lenta y el equipo la vigilará durante una semana",
    "pt": "a compilação foi lenta e a equipa vai vigiar durante uma semana",
    "it": "la compilazione era lenta e la squadra la osserverà per una settimana",
    "nl": "de bouw was traag en het team houdt het een week in de gaten",
    "pl": "kompilacja była wolna i zespół będzie ją obserwować przez tydzień",
    "ru": "сборка была медленной и команда будет следить за ней неделю",
    "ja": "ビルドは遅く、チームは一週間見守ることにした。",
}


def test_labels():
    assert [label_language(x) for x in ("en", "EN", "en-US", "en_GB", "English", "eng", "ger", "pt-BR", "jpn")] == ["en"] * 6 + ["de", "pt", "ja"]
    assert [label_language(x) for x in (None, "", "xx", "und", "N/A", "unknown", " ")] == [None] * 7
    assert label_language("sv") == "?"


def test_prose_or_not():
    for line in ("", "   ", "-----", "2024-06-14T00:26:28Z scan_stream elapsed=0.691s", "    fetch_queue(x4, n=89);", "[592a0e77] 0x337a41 92259", "    loadBatch(x5, n=2);", "12 34,5 %"):
        assert not is_prose(natural_words(line)), line
    for line in ("> The retry loop recovered.", "- Een van de werkers", "| was slow", '{"id": 3, "prompt": "the build\\nwas slow"}', "[worker-0] the build was slow", "一週間見守る"):
        assert is_prose(natural_words(line)), line


@pytest.fixture(scope="module")
def model(spark):
    return fit(table(spark, "/root/testdata/sf0.01", "documents"), "doc_id", "text", "lang")


def test_held_out_accuracy_by_agreement_with_labels(spark, small, model):
    """Most labels are right, so a good classifier agrees with most of them on documents it never saw."""
    docs = table(spark, "/root/testdata/sf0.1", "documents").filter("doc_id > 2000 and lang in ('en','de','fr','es','pt','it','nl','pl','ru','ja')").limit(1500)
    lines = line_languages(docs, model=model)
    n, right = lines.selectExpr("count(*)", "count_if(seg_lang = named)").first()
    assert n > 3000 and right / n > 0.9
    sure = lines.selectExpr("avg(confidence)").first()[0]
    assert sure > 0.97


def test_bulk_labels_equal_spans(spark, model):
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").limit(300).collect()]
    for text, got in zip(texts, model.label(texts), strict=True):
        lines = [(n, w) for n, w in ((n, natural_words(x)) for n, x in enumerate(text.split("\n"))) if is_prose(w)]
        assert [(n, s[0]) for (n, _), s in zip(lines, model.spans([w for _, w in lines]), strict=True)] == [x[:2] for x in got]


def test_lines_documents_spans(spark, model):
    rows = [(i, text, code, "x") for i, (code, text) in enumerate(SPEECH.items())]
    rows += [(20, SPEECH["en"] + "\n\n2024-06-14T00:26:28Z a_b elapsed=1s\n> " + SPEECH["ru"], "en", "x"), (21, SPEECH["de"], "nl", "x"), (22, SPEECH["ja"], None, "x"), (23, "", "en", "x"), (24, None, "en", "x"), (25, SPEECH["it"].upper(), "IT", "x"), (26, (SPEECH["pl"] + "\n") * 2000, "pl", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, seg_lang string")
    got = {}
    for r in line_languages(docs, model=model).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, code in enumerate(SPEECH):
        assert [r["seg_lang"] for r in got[i]] == [code]
    assert [(r["line_no"], r["seg_lang"]) for r in got[20]] == [(0, "en"), (3, "ru")] and got[20][0]["languages"] == 2
    assert got[21][0]["mislabelled"] and got[22][0]["mislabelled"] and not got[25][0]["mislabelled"]
    assert 23 not in got and 24 not in got and len(got[26]) == 2000
    main = {r["doc_id"]: r["doc_lang"] for r in document_languages(line_languages(docs, model=model)).collect()}
    assert main[26] == "pl"
    mixed = spark.createDataFrame([(1, (SPEECH["en"] + ". ") * 3 + (SPEECH["de"] + ". ") * 3, "en")], "doc_id long, text string, lang string")
    assert [r["seg_lang"] for r in language_spans(mixed, model=model).orderBy("first_word").collect()] == ["en", "de"]
    assert line_languages(docs.limit(0), model=model).count() == 0


def test_without_labels_function_words_decide(spark):
    docs = spark.createDataFrame([(1, SPEECH["en"], None)], "doc_id long, text string, lang string")
    assert [r["seg_lang"] for r in line_languages(docs).collect()] == ["en"]


def test_training_washes_out_foreign_passages():
    rnd = random.Random(1)
    samples = [(c, "\n".join([SPEECH[c]] * 3 + ([SPEECH["en"]] if rnd.random() < 0.4 else []))) for c in LANGUAGES[:8] for _ in range(20)]
    m = LanguageModel.trained(samples)
    assert m.label([SPEECH["en"]])[0][0][1] == "en"
