"""Encoding of a corpus with a public tokenizer through a table of distinct words.

The texts are split into words by Spark's regular expressions. Documents are
packed into blocks: a block holds each of its words once and its positions as
codes into them. Only the blocks' distinct words are shuffled; each distinct
word of the corpus is encoded once, its ids go back to the blocks that hold it,
and each block lays them out by position. What is shuffled therefore follows
the number of distinct words a block, not the length of the texts.

Defined results: null and empty texts give an empty list; blank texts are
encoded as they stand; strings that spell special tokens are ordinary text;
rows are kept as they come, repeated ids included.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import bounded_batches, keep

TOKENIZERS = "/opt/tokenizers"
# fixed value: the pattern that splits text before the merges of the byte-level rank files
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_POSITIONS = 1 << 18
HOT_SAMPLE = 256  # blocks that the most common words are looked for in
HOT_WORDS = 10_000
BLOCK_DOCS = 1 << 14


def ranks_path(name: str, folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.tiktoken"


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


def split_words(texts: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, words, odd: the words in order; a text with code points unknown to the JVM comes out whole as odd."""
    unknown = F.col(text).rlike(r"\p{Cn}")
    words = F.regexp_extract_all(F.col(text), F.lit("(?U)" + PATTERN), F.lit(0))
    return texts.select(F.col(doc_id).alias("doc"), F.when(~unknown, words).alias("words"), F.when(unknown, F.col(text)).alias("odd"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack documents into blocks of distinct words and codes."""
    split = regex.compile(PATTERN)
    task, number = TaskContext.get().partitionId(), 0
    docs: list[pa.Array] = []
    lists: list[pa.Array] = []
    positions = rows = 0

    def block() -> pa.RecordBatch:
        nonlocal number, positions, rows
        ids = pa.concat_arrays(docs)
        lengths = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]).astype(np.int32)
        coded = pa.chunked_array([x.flatten() for x in lists], pa.string()).combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        codes = codes.astype(np.uint16 if len(coded.dictionary) < 1 << 16 else np.uint32)
        name = (task << 32) | number
        number += 1
        docs.clear()
        lists.clear()
        positions = rows = 0
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([lengths.tobytes()]), pa.array([codes.tobytes()]), pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)],
            names=["block", "docs", "lengths", "codes", "words"],
        )

    for batch in batches:
        words, odd = batch.column("words"), batch.column("odd")
        if odd.null_count < len(odd):
            words = pa.array([w if o is None else split.findall(o) for w, o in zip(words.to_pylist(), odd.to_pylist())], pa.list_(pa.string()))
        words = words.fill_null([])
        start = 0
        sizes = np.diff(words.offsets.to_numpy())
        while start < len(words):
            room = np.searchsorted(np.cumsum(sizes[start:]), BLOCK_POSITIONS - positions, "right") + 1
            stop = min(len(words), start + min(int(room), BLOCK_DOCS - rows))
            docs.append(batch.column("doc").slice(start, stop - start))
            lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes[start:stop])].astype(np.int32)), words.slice(start, stop - start).flatten()))
            positions += int(sizes[start:stop].sum())
            rows += stop - start
            start = stop
            if positions >= BLOCK_POSITIONS or rows >= BLOCK_DOCS:
                yield block()
    if rows:
        yield block()


def _lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lay the ids of a block's words out by position."""
    for batch in batches:
        for k in range(batch.num_rows):
            docs = batch.column("docs").slice(k, 1).flatten()
            lengths = np.frombuffer(batch.column("lengths")[k].as_py(), np.int32)
            pairs = batch.column("coded").slice(k, 1).flatten()
            order = np.argsort(pairs.field("pos").to_numpy())
            lists = pairs.field("ids").take(pa.array(order))
            flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            raw = batch.column("codes")[k].as_py()
            codes = np.frombuffer(raw, np.uint16 if len(lists) < 1 << 16 else np.uint32).astype(np.int64)
            sizes = np.diff(offsets).astype(np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            # place of each id: the start of its word's ids, and its number within the word
            source = np.repeat((offsets[codes] if len(codes) else np.zeros(0, np.int64)) - (ends - sizes), sizes) + np.arange(total)
            ids = flat[source] if total else np.zeros(0, np.int32)
            bounds = np.r_[0, ends][np.r_[0, np.cumsum(lengths)]]
            yield pa.RecordBatch.from_arrays([docs, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc", "ids"])


def word_blocks(texts: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The corpus as a kept table of blocks."""
    bounded_batches(texts.sparkSession)
    kind = dict(texts.dtypes)[doc_id]
    return keep(split_words(texts, doc_id, text).mapInArrow(_pack, f"block bigint, docs array<{kind}>, lengths binary, codes binary, words array<string>"), "blocks")


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """word, ids of each distinct word."""

    @F.pandas_udf("array<int>")
    def ids(batch: pd.Series) -> pd.Series:
        encode = encoding(path).encode_ordinary
        return batch.map(encode)

    return words.distinct().select("word", ids("word").alias("ids"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of ids of each document of a block."""
    for batch in batches:
        for k in range(batch.num_rows):
            lengths = np.frombuffer(batch.column("lengths")[k].as_py(), np.int32)
            pairs = batch.column("coded").slice(k, 1).flatten()
            per_word = np.zeros(len(pairs), np.int64)
            per_word[pairs.field("pos").to_numpy()] = pairs.field("n").to_numpy()
            codes = np.frombuffer(batch.column("codes")[k].as_py(), np.uint16 if len(pairs) < 1 << 16 else np.uint32)
            sums = np.r_[0, np.cumsum(per_word[codes])] if len(codes) else np.zeros(1, np.int64)
            bounds = np.r_[0, np.cumsum(lengths)]
            yield pa.RecordBatch.from_arrays([batch.column("docs").slice(k, 1).flatten(), pa.array(sums[bounds[1:]] - sums[bounds[:-1]])], names=["doc", "n_tokens"])


def _hot_words(blocks: DataFrame) -> list[str]:
    """Words of at least half of HOT_SAMPLE blocks, HOT_WORDS at most; only their way is decided by it. None in a corpus of few blocks."""
    total = blocks.count()
    if total < HOT_SAMPLE:
        return []
    drawn = blocks.where(F.pmod(F.xxhash64("block", F.lit(5)), F.lit(1 << 30)) < F.lit(int((1 << 30) * HOT_SAMPLE / total)))
    counted = drawn.select(F.explode("words").alias("word")).groupBy("word").count().where(F.col("count") >= HOT_SAMPLE // 2)
    return [r.word for r in counted.orderBy(F.desc("count"), "word").limit(HOT_WORDS).collect()]


def _join_back(blocks: DataFrame, path: str, value: F.Column, kind: str) -> DataFrame:
    """The blocks, each with what its distinct words were given."""
    words = blocks.select("block", F.posexplode("words").alias("pos", "word"))
    given = encode_words(words.select("word"), path).select("word", value)
    hot = _hot_words(blocks)
    if hot:
        # words of most blocks would all meet in one task: their few rows are sent to the blocks
        table = blocks.sparkSession.createDataFrame([(w,) for w in hot], "word string")
        sent = F.broadcast(encode_words(table, path).select("word", value))
        matched = words.join(sent, "word").unionByName(words.join(F.broadcast(table), "word", "left_anti").join(given.join(F.broadcast(table), "word", "left_anti"), "word"))
    else:
        matched = words.join(given, "word")
    coded = matched.groupBy("block").agg(F.collect_list(F.struct("pos", kind.split(":")[0])).alias("coded"))
    empty = F.array().cast(f"array<struct<pos:int,{kind}>>")
    return blocks.drop("words").join(coded, "block", "left").select("docs", "lengths", "codes", F.coalesce("coded", empty).alias("coded"))


def encode_texts(texts: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id and ids of every row."""
    kind = dict(texts.dtypes)[doc_id]
    joined = _join_back(word_blocks(texts, doc_id, text), ranks_path(tokenizer, folder), F.col("ids"), "ids:array<int>")
    return joined.mapInArrow(_lay_out, f"doc {kind}, ids array<int>").withColumnRenamed("doc", doc_id)


def count_tokens(texts: DataFrame, carried: list[str], text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The carried columns and n_tokens of every row; the ids themselves are never laid out."""
    rows = texts.select(F.struct(*carried).alias("row"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["row"]
    joined = _join_back(word_blocks(rows, "row", "text"), ranks_path(tokenizer, folder), F.size("ids").alias("n"), "n:int")
    return joined.mapInArrow(_count, f"doc {kind}, n_tokens bigint").select("doc.*", "n_tokens")


def pieces(spark: SparkSession, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """id and piece (bytes) of the vocabulary: a table of fixed size."""
    ranks = load_ranks(ranks_path(tokenizer, folder))
    return spark.createDataFrame(pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "piece": pa.array(list(ranks), pa.binary())}).to_pandas(), "id int, piece binary")


def _pack_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack lists of ids into blocks of distinct ids and codes."""
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        lists = batch.column("ids").fill_null([])
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            base = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + BLOCK_POSITIONS, "right")))
            ids, codes = np.unique(flat[base : ends[stop - 1]], return_inverse=True)
            docs = batch.column("doc").slice(start, stop - start)
            yield pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) | number]), pa.ListArray.from_arrays([0, len(docs)], docs), pa.array([sizes[start:stop].astype(np.int32).tobytes()]), pa.array([codes.astype(np.uint16 if len(ids) < 1 << 16 else np.uint32).tobytes()]), pa.ListArray.from_arrays([0, len(ids)], pa.array(ids.astype(np.int32)))],
                names=["block", "docs", "lengths", "codes", "ids"],
            )
            number += 1
            start = stop


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the pieces of a block by position; bytes become text at the end, for a character may lie in two pieces."""
    for batch in batches:
        for k in range(batch.num_rows):
            lengths = np.frombuffer(batch.column("lengths")[k].as_py(), np.int32)
            n = batch.column("n_ids")[k].as_py()
            pairs = batch.column("spelt").slice(k, 1).flatten()
            known = [b""] * n  # an id without a piece spells nothing
            for pos, piece in zip(pairs.field("pos").to_pylist(), pairs.field("piece").to_pylist()):
                known[pos] = piece
            codes = np.frombuffer(batch.column("codes")[k].as_py(), np.uint16 if n < 1 << 16 else np.uint32).tolist()
            texts, at = [], 0
            for size in lengths.tolist():
                texts.append(b"".join(map(known.__getitem__, codes[at : at + size])).decode("utf-8", "replace"))
                at += size
            yield pa.RecordBatch.from_arrays([batch.column("docs").slice(k, 1).flatten(), pa.array(texts, pa.string())], names=["doc", "text"])


def decode_ids(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Text of each list of ids, through a join of each block's distinct ids with the table of pieces.

    The vocabulary (fixed at about 50,000 pieces) is broadcast. Null lists
    spell the empty text; rows need not have different ids.
    """
    kind = dict(encoded.dtypes)[doc_id]
    rows = encoded.select(F.col(doc_id).alias("doc"), F.col(ids).alias("ids"))
    blocks = keep(rows.mapInArrow(_pack_ids, f"block bigint, docs array<{kind}>, lengths binary, codes binary, ids array<int>"), "ids")
    own = blocks.select("block", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(pieces(encoded.sparkSession, tokenizer, folder)), "id")
    spelt = own.groupBy("block").agg(F.collect_list(F.struct("pos", "piece")).alias("spelt"))
    joined = blocks.withColumn("n_ids", F.size("ids")).drop("ids").join(spelt, "block", "left").withColumn("spelt", F.coalesce("spelt", F.array().cast("array<struct<pos:int,piece:binary>>")))
    return joined.select("docs", "lengths", "codes", "n_ids", "spelt").mapInArrow(_spell, f"doc {kind}, text string").withColumnRenamed("doc", doc_id)
