import random

import numpy as np
import pytest

from quillspark.llm import scans as S
from quillspark.llm.boosting import Boosted

WORDS = "archive record keeper winter letter question catalogue register inventory memorandum passage northern description correspondence committee municipal harbour lighthouse journal questionnaire derivation translation provisional technical agricultural".split()
SCHEMA = "payload_id bigint, extractor_id string, markdown string, line_no int, word string, text string"


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = Boosted().fit(x[:2000], y[:2000])
    assert ((m.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def corpus(spark):
    rng = random.Random(8)
    compounds = ["half-finished", "long-term"]
    rows, truth = [], set()
    for i in range(60):
        rows.append((i, "text", " ".join(rng.choice(WORDS + compounds) for _ in range(200)) + ".", 1, "x", None))
    for i in range(100, 160):
        out = []
        emit = out.append
        for page in range(1, 4):
            emit(f'<a id="page:{page}"></a>')
            emit("")
            emit(f"Journal of {WORDS[i % 20].capitalize()} Volume {i % 20}")
            truth.add((i, len(out), "furniture"))
            for _ in range(14):
                line = [rng.choice(WORDS) for _ in range(8)]
                if rng.random() < 0.2:
                    at = rng.randrange(1, 7)
                    line[at] = line[at].replace("e", "c", 1).replace("o", "0", 1)
                    if line[at] not in WORDS:
                        truth.add((i, len(out) + 1, "misread"))
                cut = rng.random()
                if cut < 0.15:
                    emit(" ".join(line) + " ques-")
                    truth.add((i, len(out), "hyphen"))
                    emit("tionnaire " + " ".join(rng.choice(WORDS) for _ in range(6)))
                elif cut < 0.25:
                    emit(" ".join(line) + " half-")
                    emit("finished " + " ".join(rng.choice(WORDS) for _ in range(6)))
                else:
                    emit(" ".join(line))
            emit("the record keeper.".replace("the", "winter"))
            emit(f"Page {page + i} of {i + 9}")
            truth.add((i, len(out), "furniture"))
        rows.append((i, "pdf" if i % 2 else "image", "\n".join(out), None, None, "y"))
    rows += [(900, "pdf", None, None, None, None), (901, "image", "", None, None, None), (None, "pdf", "x", None, None, None), (902, "pdf", "\n\n", None, None, None), (903, "pdf", "archive " * 60_000, None, None, None), (904, None, "archive", None, None, None)]
    return spark.createDataFrame(rows + rows[70:75], SCHEMA), truth


@pytest.fixture(scope="module")
def found(spark):
    payloads, truth = corpus(spark)
    return payloads, S.keep(S.find_noise(payloads), "noise"), truth


def test_found(found):
    _, noise, truth = found
    got = [tuple(r) for r in S.noise_rows(noise).collect()]
    assert len(got) == len(set(got))
    assert not {g for g in got if g[0] is None or g[0] in (900, 901, 902, 903, 904)}
    for defect in ("furniture", "hyphen", "misread"):
        a, b = {g for g in got if g[2] == defect}, {t for t in truth if t[2] == defect}
        assert len(a & b) >= 0.9 * len(b), defect
        assert len(a - b) <= 0.1 * len(b), defect


def test_repaired(found):
    payloads, noise, _ = found
    texts = {r.payload_id: r.text for r in S.repair_text(payloads, noise).collect()}
    own = [t for i, t in texts.items() if 100 <= i < 160]
    assert len(own) == 60
    whole = " ".join(own)
    assert "Volume" not in whole and " of 1" not in whole and "ques-" not in whole
    assert "questionnaire" in whole and "half-finished" in whole and "half- " not in whole


def test_numbers_and_lines():
    digits = {"l": "1", "z": "2", "o": "0", "s": "5"}
    assert [S.as_number(x, digits) for x in ("l79", "xiv", "ZO9", "abc", "S")] == [179, 14, 209, None, 5]
    assert S.reads_as("Z4B", 248) and not S.reads_as("Z4B", 258) and not S.reads_as("Z4B", 24)
    assert S.near("Seasonal Repair L0g of Morgard", "Seasonal Repair Log of Morgard") and not S.near("Method", "Remarks")
    text = '<a id="page:1"></a>\n\n# T\nA long-\nterm plan of ques-\ntions.\n\nNext.'
    places = [{"line_no": 4, "defect": "compound", "word": "longterm", "fixed": None}, {"line_no": 5, "defect": "hyphen", "word": "questions", "fixed": None}]
    assert S.repaired(text, places) == "# T\n\nA long-term plan of questions.\n\nNext."


def test_both_ways_of_the_inverted_join(spark, monkeypatch):
    rng = random.Random(1)
    entries = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(2, 8))) for _ in range(300)})
    lexicon = spark.createDataFrame([(w, 5 + k % 9) for k, w in enumerate(entries)], "word string, n bigint")
    asked = spark.createDataFrame([(w,) for w in sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(2, 8))) for _ in range(150)})], "word string")
    want = {(a.word, b) for a in asked.collect() for b in entries if a.word != b and abs(len(a.word) - len(b)) <= 2 and len(S._key_set(a.word) & S._key_set(b)) >= S._least(len(S._keys(a.word)))}
    got = lambda: {(r.word, k.entry) for r in S.candidates(asked, lexicon).collect() for k in r.known}
    assert got() == want
    monkeypatch.setattr(S, "FREQUENT", 40)
    assert got() == want


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    noise = S.find_noise(none)
    assert noise.count() == 0 and S.repair_text(none, noise).count() == 0


def test_parts_beyond_the_dictionary_have_their_counts(spark, monkeypatch):
    monkeypatch.setattr(S, "FREQUENT", 2)
    lexicon = spark.createDataFrame([("the", 90), ("of", 80), ("lamp", 7), ("house", 4)], "word string, n bigint")
    rows = [(1, 1, 2, "join", "lamphouse", "lamp-house", 4, False, 0, 0), (1, 3, 4, "join", "ofthe", "of-the", 2, False, 80, 90), (1, 5, 6, "join", "lampzz", "lamp-zz", 4, False, 0, 0), (1, 7, None, "word", "lamp", None, 4, False, 0, 0), (1, 9, None, "furniture", None, None, None, None, None, None)]
    asks = spark.createDataFrame(rows, S.ASKS.format(kind="bigint"))
    got = S._part_counts(asks, lexicon)
    assert got.columns == asks.columns
    assert sorted((r.line_no, r.n_left, r.n_right) for r in got.collect()) == [(1, 7, 4), (3, 80, 90), (5, 7, 0), (7, 0, 0), (9, None, None)]
    assert S._counts(lexicon, {"lamp", "zz"}, {"the": 90, "of": 80}) == {"the": 90, "of": 80, "lamp": 7}


def test_every_template_and_sequence_counts(spark):
    name = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(4))
    lines = [f"archive {name(k)}" for k in range(20_400)]
    text = "\n".join(f'<a id="page:{k}"></a>\n' + "\n".join(lines[k : k + 3]) for k in range(0, len(lines), 3))
    scans = spark.createDataFrame([(k, text) for k in range(S.TEMPLATE_PAYLOADS)], "payload_id bigint, text string")
    assert S._templates(scans)[0] == set(lines)
    rng = np.random.default_rng(4)
    words = sorted({"".join(chr(97 + c) for c in w) for w in rng.integers(0, 26, (20_000, 8))})
    want = np.zeros(S.GRAM_BUCKETS)
    for w in words:
        for g in set(S.grams(w)):
            want[S.gram_bucket(g)] += 3
    counts, total = S._sequences(spark.createDataFrame([(w, 3) for w in words] + [("a-b", 9)], "word string, n bigint"))
    for g in set(S.grams("a-b")):
        want[S.gram_bucket(g)] += 9
    assert (counts == want).all() and total == 3 * len(words)


def test_channel_is_learnt():
    """The pairs of what was read and what is true come from the words alone, new words among them."""
    rng = random.Random(6)
    true = [("rn", "m"), ("c", "e"), ("1", "l")]
    offered = []
    for k in range(400):
        w = rng.choice(WORDS)
        places = [(r, t) for r, t in true if t in w]
        if places and k % 3:
            r, t = rng.choice(places)
            w, known = w.replace(t, r, 1), [(w, 50)]
        else:
            w, known = "".join(rng.sample("abdfghijkqsuvwxyz", 6)), []
        offered.append((w, known + [(x, 9) for x in rng.sample(WORDS, 4)]))
    channel = S.learn_channel(offered)
    assert sorted(channel.logs, key=channel.logs.get)[-3:] == sorted(true, key=channel.logs.get)
    assert channel.score("1etters", "letters") > channel.score("setters", "letters") and channel.score("1ettcrs", "letters") > channel.FLOOR
    assert channel.digits() == {"l": "1", "|": "1"}


def test_channel_of_all_words(spark):
    """More words than the driver takes are learnt from as well, with the same weights; none is left out."""
    rng = random.Random(7)
    offered = sorted({(w.replace("e", "c", 1) if k % 2 else w[:2] + rng.choice("xyz") + w[2:], tuple((x, 20 + len(x)) for x in [w, *rng.sample(WORDS, 3)])) for k, w in enumerate(rng.choices(WORDS, k=600))})
    words = {read: [(x, n) for x, n in known] for read, known in offered}
    want = S.learn_channel(list(words.items()))
    frame = spark.createDataFrame([(w, [{"entry": x, "n": n} for x, n in ks]) for w, ks in words.items()], "word string, known array<struct<entry:string,n:bigint>>")
    got = S.learn_channel_joined(frame)
    assert got.logs.keys() == want.logs.keys() and all(abs(got.logs[p] - want.logs[p]) < 1e-9 for p in want.logs) and len(want.logs) > 1


def test_no_word_is_left_out_of_the_channel(spark, monkeypatch):
    payloads, _ = corpus(spark)
    fit, caught = S._fit, []
    monkeypatch.setattr(S, "_fit", lambda *a: caught.append(fit(*a)) or caught[-1])
    for size in (S.CHANNEL_WORDS, 4):
        monkeypatch.setattr(S, "CHANNEL_WORDS", size)
        S.find_noise(payloads)
    one, many = (c.channel.logs for c in caught)
    assert len(one) > 1 and one.keys() == many.keys() and all(abs(one[p] - many[p]) < 1e-9 for p in one)


def damaged(spark, planted=False):
    payloads, truth = corpus(spark)
    if planted:
        texts = {r.payload_id: r.markdown for r in payloads.select("payload_id", "markdown").collect() if r.payload_id and 100 <= r.payload_id < 160}
        odd = sorted({w.strip(".") for i, no, d in truth if d == "misread" for w in texts[i].split("\n")[no - 1].split() if w.strip(".-") not in {*WORDS, "ques", "half", "tionnaire", "finished"}})
        payloads = payloads.unionByName(spark.createDataFrame([(700, "text", " ".join(odd), None, None, None)], SCHEMA))
    return payloads, {t for t in truth if t[2] == "misread"}


def test_a_misspelling_in_clean_text_is_still_misread(spark):
    payloads, truth = damaged(spark, True)
    got = {tuple(r) for r in S.noise_rows(S.find_noise(payloads)).where("defect = 'misread'").collect()}
    assert len(got & truth) >= 0.9 * len(truth)


def test_corrections_come_from_the_join(spark, monkeypatch):
    payloads, truth = damaged(spark)
    monkeypatch.setattr(S, "_indexed", lambda words, entries: words.select("word", S.F.array().cast("array<struct<entry:string,n:bigint>>").alias("known")))
    noise = S.find_noise(payloads)
    assert noise.where("fixed is not null").count() == 0
