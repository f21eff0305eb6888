import random

import numpy as np
import pytest

from quillspark.llm import langid as L

WORDS = {
    "en": "the of and record archive keeper writes small letters about every question before winter closes".split(),
    "de": "der die und das archiv schreibt kleine briefe über jede frage bevor winter schließt heft nicht".split(),
    "fr": "le la les archive écrit petites lettres sur chaque question avant hiver cahier registre une".split(),
    "ru": "старый архив пишет маленькие письма о каждом вопросе перед зимой тетрадь новая запись".split(),
}
LANGUAGES = [(k, k, [k.upper(), f"{k}-XX"]) for k in WORDS]


def sentence(rng, lang, n=25):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    truth, rows = {}, []
    for k in range(400):
        langs = [rng.choice(list(WORDS))]
        if k % 5 == 0:
            langs.append(rng.choice([w for w in WORDS if w != langs[0]]))
        parts = [s for lang in langs for s in [sentence(rng, lang) for _ in range(rng.randrange(2, 4))]]
        runs, at = [], 1
        for lang in langs:
            runs.append((at, lang))
            at += sum(1 for s in parts if s.split()[0].lower() in WORDS[lang] and s.split()[1] in WORDS[lang] and s.split()[5] in WORDS[lang])
        label = langs[0].upper() if k % 7 else rng.choice([None, "xx", "", rng.choice(list(WORDS))])
        truth[k] = (runs, label)
        rows.append((k, ("\r\n\r\n" if k % 3 else "\n \n\n").join(parts), label, "extra"))
    rows += [(1000, None, "en", None), (1001, "", "en", None), (1002, "  \n\n", None, None), (1003, "12 34", "fr", None), (1004, sentence(rng, "de") * 2000, None, None)]
    return truth, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, label string"), spark.createDataFrame(LANGUAGES, "lang_code string, lang_name string, spellings array<string>")


def test_held_out_accuracy(tables):
    truth, documents, languages = tables
    model = L.fit(documents, languages)
    got = {}
    for r in L.detect(documents, model, languages).collect():
        got.setdefault(r.doc_id, []).append((r.first_para, r.lang))
    assert not {1000, 1001, 1002} & set(got)
    assert got[1003] == [(1, "fr")] and got[1004] == [(1, "de")]
    right = sum(sorted(got[k]) == runs for k, (runs, _) in truth.items())
    assert right / len(truth) >= 0.97


def test_wrong_labels(tables):
    truth, documents, languages = tables
    found = L.wrong_labels(L.detect(documents, L.fit(documents, languages), languages))
    want = {k for k, (runs, label) in truth.items() if len(runs) > 1 or (label or "").lower() != runs[0][1]} | {1004}
    assert len({r.doc_id for r in found.collect()} ^ want) <= 0.02 * len(truth)


def test_paths_need_a_reason():
    assert L.stretches(np.array([[10, 60], [20, 15], [12, 70]])).tolist() == [0, 0, 0]
    assert L.stretches(np.array([[10, 90], [99, 15], [90, 20]])).tolist() == [0, 1, 1]


def test_empty_and_unlabelled(spark):
    languages = spark.createDataFrame(LANGUAGES, "lang_code string, lang_name string, spellings array<string>")
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert L.detect(empty, L.fit(empty, languages), languages).count() == 0
    none = spark.createDataFrame([(1, "some words without any label at all", None)], "doc_id bigint, text string, lang string")
    assert L.detect(none, L.fit(none, languages), languages).first().rejected


def test_copies_of_a_text_are_drawn_once(spark):
    """Copies of one labelled text neither fill the sample nor reach the driver."""
    from pyspark.sql import functions as F

    words = {"en": "the record of the harbour office names every letter", "de": "der Vermerk des Hafenamts nennt jeden einzelnen Brief"}
    languages = spark.createDataFrame([(c, c, [c]) for c in words], "lang_code string, lang_name string, spellings array<string>")
    own = spark.createDataFrame([(f"{words[c]} {k} {k * k}", c) for c in words for k in range(30)], "text string, lang string")
    copies = spark.range(100_000).select(F.lit(words["en"] + " again and again").alias("text"), F.lit("en").alias("lang"))
    model = L.fit(own.unionByName(copies), languages)
    assert dict(zip(model.languages, model.contents))["en"].count(b"again and again") <= 2
