import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm.langid import Model, document_languages, full_sentence, label_language, labelled, language_segments, missing_languages, passages, segments, sentences

SAMPLES = [
    ("en", "The reader counts all open files while the watcher is still running. Nobody has measured the first match of the index."), ("en", "Please do not remove the old entries because the order was never fixed."),
    ("de", "Der Leser zählt alle offenen Dateien, während der Wächter noch läuft. Niemand hat den ersten Treffer gemessen."), ("de", "Bitte entferne die alten Einträge nicht, weil die Reihenfolge nie festgelegt wurde."),
    ("fr", "Le lecteur compte tous les fichiers ouverts pendant que le veilleur tourne encore."), ("ru", "Читатель считает все открытые файлы, пока наблюдатель ещё не остановлен."), ("ja", "監視が動いている間に、読み取りは開いているファイルをすべて数える。"),
]
DE = "Niemand hat die offenen Dateien gezählt, weil der Wächter läuft."
EN = "Nobody has counted the open files because the watcher is running."
RU = "Читатель считает файлы, пока наблюдатель не остановлен."
JA = "読み取りは開いているファイルをすべて数える。"


@pytest.fixture(scope="module")
def model():
    return Model(SAMPLES)


def test_sentences_by_language(model):
    for lang, text in (("en", EN), ("de", DE), ("ru", RU), ("ja", JA), ("de", "Unbekannte Wörterbücher verzögern die Übertragung der Einträge.")):
        assert model.classify(text)[0] == lang
    assert model.classify("") == (None, 0.0) and model.classify("123 — !")[0] is None


def test_only_prose_counts():
    text = f"# {DE}\n\n{EN}\n\n- {DE}\n  {DE}\n\n| {DE} | x |\n\n```\n{DE}\n```\n\n    {DE}\n\n// {DE}\n\n/*\n{DE}\n*/\n\n012 WARN {DE}\n\n@@ a @@\n+ {DE}\n\nfix(core): {DE[:20]}\n\n> {RU}\n"
    assert passages(text) == [EN, RU]
    assert passages(None) == passages(" \r\n ") == []


def test_wrapped_sentences_and_fragments(model):
    wrapped = EN.replace(" the open", "\nthe open") + " " + DE.replace(" weil", "\r\nweil")
    assert [s[0] for s in segments(model, wrapped)] == ["en", "de"]
    assert segments(model, "Danke sehr!\n\nVielen Dank.") == []
    assert segments(model, "weil der Wächter noch immer alle offenen Dateien zählt.") == []
    assert segments(model, DE.rstrip(".")) == []
    assert sentences("Version 1.2.3 of `a.b` is out. Yes! 一。二。") == ["Version 1.2.3 of `a.b` is out.", "Yes!", "一。", "二。"]
    assert full_sentence("See `a b c d` in x/y/z now.") is None


#: What a sentence is, as one pattern; it takes quadratic time on text without an end mark.
_SENTENCE = re.compile(r"[^.!?。！？]*(?:[.!?](?![\s\"'”’»)\]*_]|$)[^.!?。！？]*)*(?:[.!?。！？]+[\"'”’»)\]*_]*)(?=\s|$|(?<=[。！？]))")


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet="ab .!?。！\"')*", max_size=14))
def test_one_pass_gives_what_the_pattern_says(text):
    assert sentences(text) == [s for m in _SENTENCE.finditer(text) if (s := m[0].strip())]


def test_long_texts_take_linear_time(model):
    for part in ("word ", "a.b ", "(", "[", "<", "`", "_", "aA", "{ ", "= x ", "x|", "> ", "1.", "no (end ", "。", 'a."b'):
        began = time.time()
        segments(model, part * (1_000_000 // len(part)))
        assert time.time() - began < 8, part


def test_labels(spark):
    cases = [("en", "en"), ("EN_gb", "en"), ("deu", "de"), ("Japanese", "ja"), ("pt-BR", "pt"), (" Fr ", "fr"), ("und", None), ("", None), (None, None), ("unknown", None), ("english-US", "en"), ("ger", None)]
    assert [label_language(a) for a, _ in cases] == [b for _, b in cases]
    df = spark.createDataFrame([(a,) for a, _ in cases], "l string")
    assert [r[0] for r in df.select(labelled(df.l)).collect()] == [b for _, b in cases]


def test_frames(spark):
    samples = spark.createDataFrame(SAMPLES + [(None, "x"), ("en", None)], "lang string, text string")
    docs = spark.createDataFrame(
        [(1, f"{EN} {EN}\n\n{DE}", "en", "s"), (2, DE, None, "s"), (3, None, "en", "s"), (4, "", "en", "s"), (5, EN, "English", "s"), (5, EN, "English", "s"), (6, RU, "en-GB", "s"), (7, (EN + " ") * 3000, "de", "s")],
        "doc_id long, text string, lang string, segment string",
    )
    found = language_segments(docs, "doc_id", "text", samples, label="lang")
    assert {tuple(r) for r in missing_languages(found).collect()} == {(1, "de"), (2, "de"), (6, "ru"), (7, "en")}
    verdicts = {r.doc_id: (r.lang, r.verdict) for r in document_languages(docs, found, "doc_id", "lang").collect()}
    assert verdicts == {1: ("en", "right"), 2: ("de", "missing"), 3: (None, "unknown"), 4: (None, "unknown"), 5: ("en", "right"), 6: ("ru", "wrong"), 7: ("en", "wrong")}
    assert all(0 < r.confidence <= 1 for r in found.collect())
    assert language_segments(docs.limit(0), "doc_id", "text", samples).count() == 0
