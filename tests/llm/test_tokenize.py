import os
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
from quillspark.llm import tokenize as T  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.exists(T.ranks_path("byte_bpe_50k")), reason="no vocabulary files here")
SCHEMA = "doc_id bigint, text string, ids string, word string, block string"


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(3)
    alphabet = "ab  \n\t\r 　​﻿'sdtmlé9½三🗂️👩‍💻́\u0085 ß𐐀𞤀"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(300)] + ["<|endoftext|> it's  we'LL", " ", "\n\n", "\U00031350 \U0001e030x", "x" * 300_000, " \n" * 50_000 + "a"]


def test_equals_the_public_tokenizer(spark, reference):
    texts = [None, "", *odd_texts(), "same", "same"]
    rows = [(k, t, "x", None, "y") for k, t in enumerate(texts)] + [(None, "null id", None, None, None)]
    got = T.encode_texts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.ids for r in got}
    for k, t, *_ in rows:
        assert by[k] == reference(t), repr(t)[:80]


def test_blocks_of_any_size(spark, reference, monkeypatch):
    texts = odd_texts()[:60] + [None, ""] * 5
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1)
    monkeypatch.setattr(T, "BLOCK_POSITIONS", 37)
    monkeypatch.setattr(T, "BLOCK_DOCS", 4)
    packed = T.split_words(df, "doc_id", "text")
    assert {r.doc_id: r.ids for r in T.encode_texts(df).collect()} == {k: reference(t) for k, t in enumerate(texts)}
    assert packed.count() == len(texts)


def test_round_trip_and_counts(spark, reference):
    texts = [None, "", *odd_texts()[:100], "y" * 20_000 + "é"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    encoded = T.encode_texts(df)
    assert {r.doc_id: r.text for r in T.decode_ids(encoded).collect()} == {k: t or "" for k, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in T.count_tokens(df, ["doc_id"]).collect()} == {k: len(reference(t)) for k, t in enumerate(texts)}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert T.encode_texts(empty).count() == 0 and T.decode_ids(T.encode_texts(empty)).count() == 0


def test_words_of_most_blocks_go_their_own_way(spark, monkeypatch):
    rows = [(k, f"the word the {k} the {'x' * (k % 5)}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    plain = {r.doc_id: r.ids for r in T.encode_texts(docs).collect()}
    monkeypatch.setattr(T, "HOT_SAMPLE", 2)
    assert " the" in T._hot_words(T.word_blocks(docs, "doc_id", "text"))
    assert {r.doc_id: r.ids for r in T.encode_texts(docs).collect()} == plain
