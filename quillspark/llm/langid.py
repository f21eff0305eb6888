"""Language of documents and of their stretches by compression.

A text compresses best with a dictionary of its own language. For each
language a raw-content zstandard dictionary is made of a bounded sample of
labelled paragraphs; as some labels are wrong, the sample is cleaned by its own
dictionaries for a few rounds. Every paragraph of every document is compressed
with every dictionary that fits its script; the smallest result names the
language. Along a document a change of language must save at least
``SWITCH_BYTES``, so that headings, numbers and names between paragraphs make
no stretch of their own. Where the best two languages are nearer to each other
than ``MIN_MARGIN`` the stretch is rejected: a valid label stands, else the
nearest guess comes out with its low confidence.

Defined results: null, empty and blank texts (white space of any kind) have no
stretch and no row; a document without letters gets the label it has, or the
nearest guess; repeated rows give repeated results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.keys import BLANKS
from quillspark.session import bounded_batches

SAMPLE_DOCS = 200  # labelled documents a language that the dictionaries are made of
SAMPLE_PARAGRAPHS = 3  # paragraphs of each, of at most SAMPLE_CHARS
SAMPLE_CHARS = 1000
DICTIONARY_BYTES = 1 << 16
ROUNDS = 3
LEVEL = 3
SWITCH_BYTES = 14
MIN_MARGIN = 0.02
MAX_LANGUAGES = 1000

PARAGRAPH = re.compile(r"\n(?:[^\S\n]*\n)+")


def paragraphs(text: str) -> list[str]:
    """Pieces between blank lines; CRLF and CR end lines as LF does."""
    return [p for p in PARAGRAPH.split(text.replace("\r\n", "\n").replace("\r", "\n").strip()) if p.strip()]


class Classifier:
    """Sizes of texts under the dictionaries of all languages."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.languages = sorted(dictionaries)
        self.contents = [dictionaries[k] for k in self.languages]

    @lru_cache(maxsize=1)  # noqa: B019
    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content in self.contents:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False))
        return made

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "contents": self.contents}

    def sizes(self, texts: list[str]) -> np.ndarray:
        """A row a text, a column a language."""
        raw = [t.encode() for t in texts]
        # a dictionary at a time, so that it stays in the processor's cache
        return np.array([[len(c.compress(r)) for r in raw] for c in self._compressors()], np.int32).reshape(len(self.languages), len(raw)).T


def stretches(sizes: np.ndarray, switch: int = SWITCH_BYTES) -> np.ndarray:
    """The language of each paragraph of a document: the cheapest path with a price on changes."""
    n, k = sizes.shape
    if n == 1:
        return np.array([int(sizes[0].argmin())])
    cost, back = sizes[0].astype(np.int64), np.zeros((n, k), np.int64)
    for i in range(1, n):
        best = int(cost.argmin())
        moves = cost[best] + switch < cost
        back[i] = np.where(moves, best, np.arange(k))
        cost = np.where(moves, cost[best] + switch, cost) + sizes[i]
    path = np.zeros(n, np.int64)
    path[-1] = cost.argmin()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def label_codes(languages: DataFrame) -> dict[str, str]:
    """Spelling to code; the table of languages is small by nature, and its size is checked."""
    rows = languages.select("lang_code", "spellings").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    codes = {s.strip().lower(): r.lang_code for r in rows for s in (r.spellings or []) if s}
    return codes | {r.lang_code.strip().lower(): r.lang_code for r in rows}


def label_code(c: Column, codes: dict[str, str]) -> Column:
    """Code that a label names, else null."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.try_element_at(table, F.lower(F.btrim(c, F.lit(BLANKS))))


def fit(documents: DataFrame, languages: DataFrame, text: str = "text", lang: str = "lang") -> Classifier:
    """Dictionaries from at most SAMPLE_DOCS labelled documents a language."""
    codes = label_codes(languages)
    labelled = documents.select(F.col(text).alias("text"), label_code(F.col(lang), codes).alias("code")).where("code is not null and text is not null")
    # copies of a text are one text, both in the share to draw and in what is drawn
    counts = {r[0]: r[1] for r in labelled.groupBy("code").agg(F.approx_count_distinct(F.xxhash64("text", F.lit(3)))).collect()}
    if not counts:
        return Classifier({c: b"\n" for c in sorted(set(codes.values()))})
    share = F.try_element_at(F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1.0, 1.2 * SAMPLE_DOCS / n))]), F.col("code"))
    place = (F.xxhash64("text", F.lit(3)) / F.lit(float(1 << 63)) + 1) / 2
    parts = F.filter(F.split(F.regexp_replace("text", "\r\n?", "\n"), r"\n\s*\n"), lambda p: F.length(p).between(40, SAMPLE_CHARS))
    drawn = labelled.withColumn("place", place).where(F.col("place") < share).select("code", (F.col("place") / share).alias("place"), F.slice(parts, 1, SAMPLE_PARAGRAPHS).alias("parts")).where(F.size("parts") > 0)
    sample: dict[str, list[str]] = {c: [] for c in sorted(set(codes.values()))}
    most = 2 * SAMPLE_DOCS * len(counts)
    for r in sorted(drawn.dropDuplicates(["code", "place"]).orderBy("place", "code").limit(most).collect(), key=lambda r: (r.code, r.place, r.parts)):
        if len(sample[r.code]) < SAMPLE_DOCS * SAMPLE_PARAGRAPHS:
            sample[r.code].extend(r.parts)
    return train(sample)


def train(sample: dict[str, list[str]]) -> Classifier:
    """Dictionaries of labelled paragraphs, without those that another language's dictionary fits better.

    Each half of the sample is judged by dictionaries of the other half, for a
    paragraph always fits a dictionary that holds it. Copies are in one half.
    """
    sample = {c: sorted(set(texts), key=lambda t: (zlib.crc32(t.encode()), t)) for c, texts in sample.items()}
    kept = sample
    for _ in range(ROUNDS):
        clean: dict[str, list[str]] = {c: [] for c in sample}
        for half in (0, 1):
            model = Classifier({c: _content([t for t in texts if zlib.crc32(t.encode()) % 2 != half]) for c, texts in kept.items()})
            for code, texts in sample.items():
                judged = [t for t in texts if zlib.crc32(t.encode()) % 2 == half]
                own = model.languages.index(code)
                if judged:
                    sizes = model.sizes(judged)
                    clean[code] += [t for t, row in zip(judged, sizes) if row[own] <= row.min()]
        kept = {c: clean[c] or (sample[c] if len(sample[c]) < 3 else []) for c in sample}
    return Classifier({c: _content(texts) for c, texts in kept.items()})


def _content(texts: list[str]) -> bytes:
    return "\n".join(texts).encode()[:DICTIONARY_BYTES] or b"\n"


def detect(documents: DataFrame, model: Classifier, languages: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Stretches of all documents: doc_id, label, first_para, last_para, lang, confidence, rejected, n_langs.

    confidence is the share of bytes that the language saves against the next best.
    """
    bounded_batches(documents.sparkSession)
    codes = label_codes(languages)
    kind = dict(documents.dtypes)[doc_id]
    rows = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), label_code(F.col(lang), codes).alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            labels = batch.column("label").to_pylist()
            parts = [paragraphs(t) for t in texts]
            sizes = model.sizes([p for ps in parts for p in ps])
            out: list[tuple] = []
            at = 0
            for row, ps in enumerate(parts):
                if not ps:
                    continue
                own = sizes[at : at + len(ps)]
                at += len(ps)
                path = stretches(own)
                starts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
                ends = np.r_[starts[1:], len(ps)]
                names = len(set(path.tolist()))
                for a, b in zip(starts.tolist(), ends.tolist()):
                    total = own[a:b].sum(0)
                    best = int(path[a])
                    rest = int(np.delete(total, best).min()) if len(total) > 1 else int(total[best])
                    confidence = max(0.0, 1 - total[best] / rest) if rest else 0.0
                    rejected = confidence < MIN_MARGIN
                    name = model.languages[best]
                    if rejected and labels[row] and names == 1:
                        name = labels[row]
                    out.append((row, a + 1, b, name, float(confidence), rejected, names))
            cols = list(zip(*out)) if out else [[]] * 7
            take = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(take), batch.column("label").take(take), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.float64()), pa.array(cols[5], pa.bool_()), pa.array(cols[6], pa.int32())],
                names=["doc", "label", "first_para", "last_para", "lang", "confidence", "rejected", "n_langs"],
            )

    found = rows.mapInArrow(run, f"doc {kind}, label string, first_para int, last_para int, lang string, confidence double, rejected boolean, n_langs int")
    return found.withColumnRenamed("doc", doc_id)


def wrong_labels(found: DataFrame) -> DataFrame:
    """Stretches of documents whose label is missing, invalid or wrong, and of all that mix languages."""
    return found.where("n_langs > 1 or label is null or label <> lang")
