"""Repair of text from scanned pages.

Three kinds of noise are found line by line. *Furniture* (running headers and
footers, page numbers, stamps) is peeled off the top and bottom of each page by
boosted trees over pairs of lines: a line with the title, with the lines at the
same place of other pages, with the lines the corpus has only at the edges of
pages, and with the text before and after it. The trees are fitted on lines of
the scans themselves whose pairs leave no doubt. *Hyphens*: the last word of a line and the first
of the next text line are one word, a compound or two words; boosted trees
decide by counts of the joined and the hyphenated form and of the parts.
*Misread words*: words that are rare in clean text get correction candidates by
an inverted join on character trigrams; boosted trees rank the candidates and
decide by relative counts, by what the reading changed, and by how common the
sequences of characters are. What readings change is learnt from the corpus:
all words of scans that are rare in clean text are aligned with their
candidates, and an expectation-maximisation over the aligned pairs gives a
channel of confusions.
The trees are fitted on words of the corpus that are split or sent through this
channel here.

Defined results: null and empty texts give no row and an empty repaired text;
repeated rows of a payload count once; text without page anchors is one page;
without any clean text the words that occur five times in scans count as known.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.boosting import Boosted
from quillspark.session import bounded_batches, keep, shuffle_partitions

SCANNED = ("pdf", "image")
MARKS = "-‐¬­"
REMEMBERED = 200  # characters of a line up to which its plain form and template are remembered
EDGE = 3  # lines at the top and bottom of a page that may be furniture
TEMPLATE_PAYLOADS = 12  # payloads that make a line a template of the corpus
FREQUENT = 50_000  # entries of the lexicon in the index that is sent out; all others meet the words by a shuffle
COMMON_SHARE = 1 / FREQUENT  # share of the clean text that makes a word common: at most FREQUENT words have it
SAMPLE_SCANS = 500  # scans that the trees for furniture are fitted on, at most SAMPLE_CHARS characters each
SAMPLE_CHARS = 60_000
SAMPLE_WORDS = 3000  # words of the corpus that the trees are fitted on
RARER = 50  # how much rarer in clean text than its true spelling a misspelling is, at least
CHANNEL_WORDS = 12_000  # words of scans up to which the channel is learnt on the driver; from more it is learnt by joins, with the same result
NEW_WORD = 2e-4  # share of words that stem from no candidate, against pairs never met elsewhere
GRAM_BUCKETS = 1 << 20  # counts of character sequences are kept by hash, so that their size is bounded
LEAST_SHARED = ((10, 0.5), (6, 0.4), (0, 0.3))  # share of a word's trigrams that a candidate has, by their number
ANCHOR = re.compile(r'<a id="[^"]*"></a>\s*$')
NUMBER = r"[0-9A-Za-z|]{1,4}"
ROMAN = re.compile(r"[ivxlcdm]{1,7}$")
NUMBERED = {
    "dash": re.compile(rf"[—–-]\s*({NUMBER}|[ivxlc]+)\s*[—–-]$"),
    "bracket": re.compile(rf"\[\s*({NUMBER}|[ivxlc]+)\s*\]$"),
    "slash": re.compile(rf"({NUMBER})\s?/\s?{NUMBER}$"),
    "word": re.compile(rf"[^\W\d_]\S{{0,6}} ({NUMBER})(?: [^\W\d_]{{1,4}} {NUMBER})?$"),
    "bare": re.compile(rf"({NUMBER}|[ivxlc]+)$"),
}
EDGED = re.compile(rf"(?:(?P<a>{NUMBER})\s{{2,}}(?P<left>\S.*)|(?P<right>\S.*?)\s{{2,}}(?P<b>{NUMBER}))$")
CHUNK_EDGE = ".,;:!?\"'()[]{}«»“”„…*_#‘’‚<>"
END = re.compile(r"[.!?:;,…][\"'»”)]*$")


def plain_letters(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    if text.isascii():
        return text
    return (_plain if len(text) <= REMEMBERED else _plain.__wrapped__)(text)


@lru_cache(maxsize=1 << 14)
def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def as_number(token: str, digits: dict[str, str]) -> int | None:
    """Value of a number, Roman or with digits that were read as letters."""
    if ROMAN.match(token):
        values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
        total = 0
        for a, b in zip(token, token[1:] + " "):
            total += -values[a] if b in values and values[b] > values[a] else values[a]
        return total
    token = "".join(digits.get(c.lower(), c) for c in token)
    return int(token) if token.isascii() and token.isdigit() else None


def reads_as(token: str, number: int) -> bool:
    """Whether the number could have been read so: as long, and no digit differs."""
    true = str(number)
    return len(token) == len(true) and all(a == b or not a.isdigit() for a, b in zip(token, true))


def template(line: str) -> str:
    """Line with its numbers put alike."""
    return (_template if len(line) <= REMEMBERED else _template.__wrapped__)(line)


@lru_cache(maxsize=1 << 14)
def _template(line: str) -> str:
    return " ".join("0" if re.search(r"\d", w) else w for w in re.split(r"[\s/]+", line.strip().lower()))


def near(a: str, b: str) -> bool:
    """Equal but for some misread characters: most words alike, the others differing in a few characters."""
    if a == b:
        return True
    if not a or not b or abs(len(a) - len(b)) > 0.2 * max(len(a), len(b)) + 1:
        return False
    return near_words(plain_letters(a).split(), plain_letters(b).split())


def near_words(x: list[str], y: list[str]) -> bool:
    if x == y:
        return True
    if len(x) != len(y):
        return False
    other = [(v, w) for v, w in zip(x, y) if v != w]
    if len(x) > 1 and len(other) > 0.4 * len(x):
        return False
    for v, w in other:
        r, t, _ = differing(v, w)
        if max(len(r), len(t)) > max(1, 0.4 * max(len(v), len(w))):
            return False
    return True


@lru_cache(maxsize=2)
def _stamp_index(stamps: frozenset[str]) -> dict[tuple, list[list[str]]]:
    """Words of the stamps by their number and by each word at its place; a stamp of one word by its beginning and end."""
    out: dict[tuple, list[list[str]]] = {}
    for s in sorted(stamps):
        if len(s) >= 6:
            words = plain_letters(s).split()
            for key in _stamp_keys(words):
                out.setdefault(key, []).append(words)
    return out


def _stamp_keys(words: list[str]) -> list[tuple]:
    if len(words) == 1:
        return [(1, 0, words[0][:3]), (1, 1, words[0][-3:])]
    return [(len(words), k, w) for k, w in enumerate(words) if w != "0"] or [(len(words), -1, "")]


class Page:
    def __init__(self, first: bool) -> None:
        self.first = first
        self.no: list[int] = []
        self.text: list[str] = []
        self.indent: list[int] = []


class Scan:
    """The pages of a payload and its furniture."""

    def __init__(self, markdown: str, stamps: set[str] | None = None, heads: set[str] | None = None, digits: dict[str, str] | None = None) -> None:
        self.digits = digits or {}
        self.lines = markdown.split("\n")
        self.pages: list[Page] = []
        self.title = ""
        self.heading_no = 0
        for k, line in enumerate(self.lines, 1):
            bare = line.strip()
            if bare.startswith("<a") and ANCHOR.match(bare):
                if bare.startswith('<a id="page:') or not self.pages:
                    self.pages.append(Page(not self.pages))
            elif bare:
                if not self.pages:
                    self.pages.append(Page(True))
                p = self.pages[-1]
                if line.startswith("#") and not self.title:
                    self.title, self.heading_no = line.lstrip("# ").strip(), k
                p.no.append(k)
                p.text.append(bare)
                p.indent.append(len(line) - len(line.lstrip()))
        if stamps is not None:
            self.stamps, self.heads = stamps, heads or set()
            wide = sorted(len(t) for p in self.pages for t in p.text if len(t) > 30)
            self.width = wide[len(wide) // 2] if wide else 60
            self.index = _stamp_index(frozenset(self.stamps))
            self.offset = self._numbering()

    def edge_lines(self) -> Iterator[tuple[str, bool]]:
        """Templates of short lines, and whether they stand at the edge of a page."""
        for p in self.pages:
            n = len(p.text)
            for k, t in enumerate(p.text):
                if len(t) <= 45 and not t.startswith("#"):
                    yield template(t), k < EDGE or k >= n - EDGE

    def _stamp(self, t: str) -> bool:
        own = template(t)
        if own in self.stamps:
            return True
        if len(own) < 6 or len(own) > 45:
            return False
        words = plain_letters(own).split()
        return any(near_words(words, s) for key in _stamp_keys(words) for s in self.index.get(key, ()))

    def _edges(self) -> tuple[list, list, list[str]]:
        """Words of the first and last lines of each page, and the last line of text before it."""
        if not hasattr(self, "_known_edges"):
            split = lambda own: [plain_letters(self._words(t)).split() for t in own]
            before, befores = "", []
            for p in self.pages:
                befores.append(before)
                before = next((t for t in reversed(p.text) if not self._number(t) and not self._stamp(t)), before)
            self._known_edges = [split(p.text[:EDGE]) for p in self.pages], [split(p.text[-EDGE:]) for p in self.pages], befores
        return self._known_edges

    def edge_facts(self, within: int = 0, place: int | None = None, sides: set[tuple[int, bool]] | None = None) -> list[tuple[int, int, bool, list[float]]]:
        """Page, line, top or bottom, and what its pairs with other lines say, of the EDGE first and last lines of each page.

        :param within: so many lines of the middle of each page are given too, as if the page began or ended there; their line is negative.
        :param place: only the lines so far from the edge, of the given sides of pages.
        """
        tops, ends, befores = self._edges()
        out = []
        for i, p in enumerate(self.pages):
            n, before = len(p.text), befores[i]
            start = 1 if n and p.no[0] == self.heading_no else 0
            for k in range(start, min(n, start + EDGE)):
                if place is None or k - start == place and (i, True) in sides:
                    out.append((i, k, True, self._facts(i, k, k - start, True, tops, before)))
            for k in range(max(start, n - EDGE), n):
                if place is None or n - 1 - k == place and (i, False) in sides:
                    out.append((i, k, False, self._facts(i, k, n - 1 - k, False, ends, before)))
            middle = range(start + EDGE, n - EDGE)
            for x in range(min(within, len(middle))):
                k = middle[(x * 7919 + i * 31) % len(middle)]
                out.append((i, -k, x % 2 == 0, self._facts(i, k, x % EDGE, x % 2 == 0, tops if x % 2 == 0 else ends, p.text[k - 1])))
        return out

    def _facts(self, i: int, k: int, place: int, top: bool, others: list[list[list[str]]], before: str) -> list[float]:
        """What a line's pairs with the title, with the lines at the same place of other pages, with the stamps and with its neighbours say."""
        p = self.pages[i]
        t, n = p.text[k], len(p.text)
        words = self._words(t)
        number = self._number(t, self.offset, i)
        style = number[0] if number else ""
        fits = bool(number) and self.offset.get(style) is not None and self.offset[style] + i == number[1]
        m = EDGED.match(t)
        side = (m["a"] or m["b"]) if m else ""
        counts = self.offset.get("edged")
        title, plain = plain_letters(self.title), plain_letters(words)
        mine = plain.split()
        same = sum(any(len(w) == len(mine) and near_words(mine, w) for w in own) for j, own in enumerate(others) if j != i) if len(words) > 1 else 0
        long_words = [w for w in words.split() if len(w) > 3]
        following = p.text[k + 1] if k + 1 < n else ""
        previous = p.text[k - 1] if k and not (top and place == 0) else before
        open_ = bool(previous) and not re.search(r"[.!?:][\"'»”)]*$", previous)
        gap = len(t) - len(words) - len(side) if m else 0
        return [
            float(x)
            for x in (
                top, place, i == 0, len(self.pages) == 1, style in ("dash", "bracket", "slash"), style == "word", style == "bare", fits, bool(ROMAN.match(t)), p.indent[k] >= 8,
                bool(m), bool(m) and counts is not None and reads_as(side, counts + i), bool(m) and as_number(side, self.digits) is not None, min(gap, 12), min(same, 4), same / max(1, len(self.pages) - 1),
                self._stamp(t), template(t) in self.heads, bool(title) and near(words, self.title), len(plain) > 3 and f" {plain} " in f" {title} ", bool(END.search(t)), t[-1] in MARKS, words[:1].isupper(), t[0].isdigit(), t.isupper(),
                sum(w[0].isupper() or not w[0].isalpha() for w in long_words) / max(1, len(long_words)), min(len(t.split()), 12), min(len(t) / self.width, 1.5), open_, previous[-1:] in MARKS, following[:1].islower(), following[:1].isupper(),
                bool(following) and self._number(following) is not None, p.no[k + 1] - p.no[k] > 1 if k + 1 < n else 2, p.no[k] - p.no[k - 1] > 1 if k else 2, any(s != style and o is not None for s, o in self.offset.items()), n <= 2 * EDGE, t.startswith("#"),
            )
        ]

    def certain(self, i: int, k: int, top: bool, facts: list[float]) -> bool | None:
        """Whether a line is furniture, where its pairs leave no doubt: it recurs at its place, counts the pages, is a number between marks or a stamp; or it is of a sentence, a known heading or the middle of a page."""
        t = self.pages[i].text[abs(k)]
        if k < 0:
            return False
        fits, counted, same, share, stamp, head, ends = facts[7], facts[11], facts[14], facts[15], facts[16], facts[17], facts[20]
        pages = len(self.pages)
        if stamp or facts[4] or pages >= 3 and (fits or counted) or same >= 2 and share >= 0.5 and not ends:
            return True
        if t[0].islower() or t[-1] in MARKS or ends and len(t) > 0.7 * self.width or head and not same or t.startswith("#"):
            return False
        return None

    def peel(self, p_furniture: dict[tuple[int, int, bool], float]) -> None:
        """Furniture from the outside of each page inwards, as long as lines are likely to be."""
        self.furniture: set[int] = set()
        for i, p in enumerate(self.pages):
            n = len(p.text)
            start = k = 1 if n and p.no[0] == self.heading_no else 0
            while k < min(n, start + EDGE) and p_furniture.get((i, k, True), 0.0) >= 0.5:
                self.furniture.add(p.no[k])
                k += 1
            low = n - 1
            while low >= max(k, n - EDGE) and p_furniture.get((i, low, False), 0.0) >= 0.5:
                self.furniture.add(p.no[low])
                low -= 1

    @staticmethod
    def _words(t: str) -> str:
        """A header's words without its page number."""
        m = EDGED.match(t)
        return ((m["left"] or m["right"]) if m else t).strip()

    def _number(self, t: str, offset: dict[str, int | None] | None = None, i: int = 0) -> tuple[str, int] | None:
        """Style and value of a page number; where the page's number is known, characters that aren't digits may stand for any."""
        for style, pattern in NUMBERED.items():
            if m := pattern.match(t):
                expected = offset[style] + i if offset and offset.get(style) is not None else None
                if expected is not None and expected > 0 and reads_as(m[1], expected):
                    return style, expected
                value = as_number(m[1], self.digits)
                if value is not None and (style != "bare" or re.search(r"\d|^[ivxlc]+$|^[A-Zl]{2,}$", t)):
                    return style, value
        return None

    def _numbering(self) -> dict[str, int | None]:
        """Offset of each style of page number from the page's index, as most pages have it."""
        seen: dict[str, Counter[int]] = {}
        for i, p in enumerate(self.pages):
            n = len(p.text)
            for k in {*range(min(EDGE, n)), *range(max(0, n - EDGE), n)}:
                if number := self._number(p.text[k]):
                    seen.setdefault(number[0], Counter())[number[1] - i] += 1
                elif k < EDGE and (m := EDGED.match(p.text[k])) and (value := as_number(m["a"] or m["b"], self.digits)) is not None:
                    seen.setdefault("edged", Counter())[value - i] += 1
        return {style: (c.most_common(1)[0][0] if c.most_common(1)[0][1] > 1 or len(self.pages) == 1 else None) for style, c in seen.items()}

    def text_lines(self) -> list[tuple[int, str]]:
        return [(no, t) for p in self.pages for no, t in zip(p.no, p.text) if no not in self.furniture]


_INNER = re.compile(r"[-‐/’']")


def parts_of(chunk: str) -> list[str]:
    """Words of a chunk; a bracket that nothing closes is a misread letter."""
    bare = chunk.strip(CHUNK_EDGE)
    if "(" in chunk and ")" not in chunk and "(" not in bare:
        at = chunk.find("(")
        if chunk[at + 1 : at + 3].isalpha() and chunk[at + 1].islower():
            bare = "(" + bare
    return [w for w in _INNER.split(bare) if w]


def peel_all(scans: list[Scan], model: Boosted) -> None:
    """Furniture of many scans, judged at once; lines further in only where those outside them are furniture."""
    likely: list[dict] = [{} for _ in scans]
    sides = [{(i, top) for i in range(len(s.pages)) for top in (True, False)} for s in scans]
    for place in range(EDGE):
        facts = [s.edge_facts(place=place, sides=own) for s, own in zip(scans, sides)]
        rows = [f[3] for own in facts for f in own]
        p = iter(model.predict(np.array(rows)).tolist() if rows else [])
        for k, own in enumerate(facts):
            judged = {f[:3]: x for f, x in zip(own, p)}
            likely[k] |= judged
            sides[k] = {(i, top) for (i, _, top), x in judged.items() if x >= 0.5}
    for s, own in zip(scans, likely):
        s.peel(own)


def fit_furniture(texts: list[str], stamps: set[str], heads: set[str], digits: dict[str, str]) -> Boosted:
    """Trees on line pairs: the labels are the scans' own lines whose pairs leave no doubt.

    Each such line is also given as if its page were the only one and its stamp
    unknown, so that the trees learn what such lines look like where no other
    page bears them out.
    """
    x, y = [], []
    for k, text in enumerate(texts):
        scan = Scan(text, stamps, heads, digits)
        pages: dict[int, dict] = {}
        for i, line, top, facts in scan.edge_facts(within=4):
            label = scan.certain(i, line, top, facts)
            if label is None:
                continue
            x.append(facts)
            y.append(label)
            pages.setdefault(i, {})[abs(line), top] = label
        for i, labels in pages.items():
            alone = Scan("", stamps if (k + i) % 3 else set(), heads, digits)
            alone.pages, alone.title, alone.heading_no, alone.width = [scan.pages[i]], scan.title, scan.heading_no, scan.width
            alone.index, alone.offset = _stamp_index(frozenset(alone.stamps)), alone._numbering()
            for _, line, top, facts in alone.edge_facts(within=4):
                if (abs(line), top) in labels:
                    x.append(facts)
                    y.append(labels[abs(line), top])
    if not any(y) or all(y):
        return Boosted(rounds=0).fit(np.array([[0.0], [1.0]]), np.array([float(any(y))] * 2))
    return Boosted(rounds=80, depth=5).fit(np.array(x), np.array(y, float))


def line_asks(scan: Scan, frequent: dict[str, int]) -> Iterator[tuple]:
    """Words to look up: line, next line, role, word, compound, length of the left part, capital, counts of the parts."""
    lines = scan.text_lines()
    skip = ""
    for k, (no, text) in enumerate(lines):
        chunks = text.split()
        if skip and chunks:
            chunks[0] = skip
        skip = ""
        joined = None
        if chunks and chunks[-1][-1] in MARKS and len(chunks[-1]) > 1 and k + 1 < len(lines):
            left = re.split(r"[-‐/’']", chunks[-1].rstrip(MARKS).lstrip(CHUNK_EDGE))[-1]
            nxt = lines[k + 1][1].split()[0].strip(CHUNK_EDGE)
            right = re.match(r"[^-‐/’'.,;:!?)]*", nxt)[0]
            if left and right and right[0] not in "0123456789" and any(c.isalpha() for c in left):
                joined = (left, right, lines[k + 1][0])
                whole = lines[k + 1][1].split()[0]
                skip = whole[whole.find(right) + len(right) :] or " "
        for c, chunk in enumerate(chunks):
            # most chunks are plain common words already
            if (chunk in frequent or chunk.strip(CHUNK_EDGE).lower() in frequent) and not (joined and c == len(chunks) - 1) and "(" not in chunk:
                continue
            own = parts_of(chunk)
            if joined and c == len(chunks) - 1:
                own = own[:-1]
                left, right, next_no = joined
                word = (left + right).lower()
                yield no, next_no, "join", word, f"{left}-{right}".lower(), len(left), left[:1].isupper(), frequent.get(left.lower(), 0), frequent.get(right.lower(), 0)
            for w in own:
                low = w.lower()
                if low in frequent or ROMAN.match(w) or not any(x.isalpha() or x in "€~|(" for x in w) and w.isascii():
                    continue
                yield no, None, "word", low, None, len(w), w[:1].isupper(), 0, 0


def is_odd(word: str) -> bool:
    """Characters that no word has."""
    return not all(c.isalpha() or unicodedata.combining(c) for c in word) or bool(re.search("[ﬁﬂ]", word))


def grams(word: str, n: int = 4) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(max(1, len(w) - n + 1))]


def differing(read: str, true: str) -> tuple[str, str, int]:
    """What stands between the common beginning and end, and where."""
    a, n = 0, min(len(read), len(true))
    while a < n and read[a] == true[a]:
        a += 1
    b = 0
    while b < n - a and read[-1 - b] == true[-1 - b]:
        b += 1
    return read[a : len(read) - b], true[a : len(true) - b], a


class Channel:
    """What reading makes of printed characters: the weight of each pair of what was read and what is true."""

    FLOOR = -14.0

    def __init__(self, weights: dict[tuple[str, str], float]) -> None:
        total = max(1e-9, sum(weights.values()))
        self.logs = {pair: math.log(w / total) for pair, w in weights.items()}
        self.edges = {(r[0], t[0]) for r, t in self.logs}, {(r[-1], t[-1]) for r, t in self.logs}
        self.by_true: dict[str, list[tuple[str, float]]] = {}
        for (read, true), w in sorted(weights.items()):
            self.by_true.setdefault(true, []).append((read, w))

    def digits(self) -> dict[str, str]:
        """The digit that each letter is taken for most often."""
        best: dict[str, tuple[float, str]] = {}
        for (read, true), w in sorted(self.logs.items()):
            if len(read) == 1 and len(true) == 1 and read.isascii() and read.isdigit() and true.isalpha() and true.isascii():
                best[true] = max(best.get(true, (-math.inf, "")), (w, read))
        return {letter: digit for letter, (_, digit) in best.items()} | {"|": "1"}

    def score(self, read: str, true: str) -> float:
        """Log weight of the pair's changes; each change that was never learnt counts FLOOR and more by its length."""
        r, t, at = differing(read, true)
        if (r, t) in self.logs:
            return self.logs[r, t]
        # a change may share a character with its surroundings, and there may be several
        best = self.FLOOR - 2.0 * max(len(r), len(t))
        if max(len(r), len(t)) > 20:
            return best
        for a in (0, 1):
            for b in (0, 1):
                if at - a >= 0 and (pair := (read[at - a : at + len(r) + b], true[at - a : at + len(t) + b])) in self.logs:
                    best = max(best, self.logs[pair])
        # the outermost characters differ, so that learnt changes must begin and end there
        if r and t and best < self.FLOOR and (r[0], t[0]) in self.edges[0] and (r[-1], t[-1]) in self.edges[1]:
            best = max(best, self._several(r, t))
        return best

    def _several(self, r: str, t: str) -> float:
        """Best way to read t as r by learnt changes and equal characters."""
        n, m = len(r), len(t)
        best = {(0, 0): 0.0}
        todo = [(0, 0, 0)]
        while todo:  # in order of characters used, so that a place is final when it is taken
            _, i, j = heappop(todo)
            here = best[i, j]
            steps = [(1, 1, 0.0)] if i < n and j < m and r[i] == t[j] else []
            steps += [(a, b, w) for a in (1, 2, 3) for b in (1, 2, 3) if (w := self.logs.get((r[i : i + a], t[j : j + b]))) is not None and i + a <= n and j + b <= m]
            for a, b, w in steps:
                if (i + a, j + b) not in best:
                    heappush(todo, (i + j + a + b, i + a, j + b))
                best[i + a, j + b] = max(best.get((i + a, j + b), -math.inf), here + w)
        return best.get((n, m), -math.inf)

    def corrupt(self, word: str, rng: np.random.Generator) -> str | None:
        """The word with one change that reading makes."""
        places = [(at, true, read, w) for at in range(len(word)) for size in (1, 2, 3) if (true := word[at : at + size]) in self.by_true and len(true) == size for read, w in self.by_true[true]]
        if not places:
            return None
        weights = np.array([w for *_, w in places])
        at, true, read, _ = places[int(rng.choice(len(places), p=weights / weights.sum()))]
        return word[:at] + read + word[at + len(true) :]


def word_options(read: str, known: list[tuple[str, int]]) -> list[tuple[tuple[str, str], float, float]]:
    """What tells a word from its candidates: each pair once, with its part of the candidates and its weight against the best of them."""
    options = []
    for true, n in known:
        r, t, at = differing(read, true)
        if not r or not t:  # something lost or added: with the character before it
            a, b = (1, 0) if at else (0, 1)
            r, t = read[at - a : at + len(r) + b], true[at - a : at + len(t) + b]
        if 0 < len(r) <= 3 and 0 < len(t) <= 3:
            options.append(((r, t), float(n) ** 0.5))
    top = max((n for _, n in options), default=1.0)
    parts: dict[tuple[str, str], tuple[float, float]] = {}
    for pair, n in options:
        part, weight = parts.get(pair, (0.0, 0.0))
        parts[pair] = part + 1.0 / len(options), weight + n / top
    return [(pair, *x) for pair, x in parts.items()]


def learn_channel(offered: list[tuple[str, list[tuple[str, int]]]], rounds: int = 8, least: float = 2.0) -> Channel:
    """Expectation-maximisation over words that clean text lacks and their candidates.

    Each word is a new word or stems from one of its candidates, in proportion
    to the weight of the pair that tells them apart and to the candidate's
    count; the pairs' weights are the sums of these shares.

    :param least: sum of shares below which a pair is left out.
    """
    words = [options for read, known in offered if (options := word_options(read, known))]
    weights: dict[tuple[str, str], float] = {}
    for options in words:
        for pair, part, _ in options:
            weights[pair] = weights.get(pair, 0.0) + part
    for _ in range(rounds):
        total = max(1e-9, sum(weights.values()))
        following: dict[tuple[str, str], float] = {}
        for options in words:
            scores = [weights.get(pair, 0.0) / total * n for pair, _, n in options]
            whole = sum(scores) + NEW_WORD
            for (pair, _, _), x in zip(options, scores):
                following[pair] = following.get(pair, 0.0) + x / whole
        weights = following
    return Channel({pair: w for pair, w in weights.items() if w >= least})


def learn_channel_joined(offered: DataFrame, rounds: int = 8, least: float = 2.0) -> Channel:
    """learn_channel over any number of words: weights meet the words' options by a join each round, only the pairs of the channel are collected.

    :param offered: word, known.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, *pair, part, n) for w, ks in zip(batch.column("word").to_pylist(), batch.column("known").to_pylist()) for pair, part, n in word_options(w, [(k["entry"], k["n"]) for k in ks])]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), *(pa.array(c, pa.float64()) for c in cols[3:])], names=["word", "read", "true", "part", "n"])

    options = keep(offered.select("word", "known").mapInArrow(expand, "word string, read string, true string, part double, n double"), "options")
    weights = keep(options.groupBy("read", "true").agg(F.sum("part").alias("weight")), "weights")
    for _ in range(rounds):
        total = max(1e-9, weights.agg(F.sum("weight")).first()[0] or 0.0)
        scored = options.join(weights, ["read", "true"]).select("word", "read", "true", (F.col("weight") / F.lit(total) * F.col("n")).alias("x"))
        shares = scored.select("read", "true", (F.col("x") / (F.sum("x").over(Window.partitionBy("word")) + F.lit(NEW_WORD))).alias("x"))
        weights = keep(shares.groupBy("read", "true").agg(F.sum("x").alias("weight")), "weights")
    return Channel({(r.read, r.true): r.weight for r in weights.where(F.col("weight") >= F.lit(least)).orderBy("read", "true").collect()})


class Speller:
    """Ranks corrections of words that are rare in clean text, and says which are misread."""

    def __init__(self, channel: Channel, buckets: np.ndarray, total: int) -> None:
        self.channel = channel
        self.counts = buckets  # of the clean text, by hash of the sequence
        self.total = max(1, total)
        self.trees: Boosted | None = None
        self.alone: Boosted | None = None
        self.joins: Boosted | None = None

    @lru_cache(maxsize=1 << 16)  # noqa: B019
    def rare(self, word: str, n: int = 0) -> tuple[float, float, float]:
        """The least, the second least and the mean log share of the word's character sequences, without n occurrences of the word itself."""
        own = sorted(math.log(max(0.3, float(self.counts[gram_bucket(g)]) - n) / self.total) for g in grams(word))
        return own[0], own[min(1, len(own) - 1)], sum(own) / len(own)

    def share(self, n: int) -> float:
        return math.log((n + 0.3) / self.total)

    def features(self, read: str, true: str, n: int, cap: bool, n_read: int, others: float, hidden: int = 0) -> list[float]:
        """:param others: best score of the word's other candidates; :param hidden: occurrences that are treated as if there were none."""
        a, b, c = self.rare(read, hidden)
        d, e, f = self.rare(true)
        score = self.channel.score(read, true)
        return [score, self.share(n), len(read), a, b, c, d, e, f, float(is_odd(read)), float(cap), len(true) - len(read), self.share(n_read), math.log((n + 0.3) / (n_read + 0.3)), a - d, score - others]

    def own_features(self, read: str, cap: bool, n_read: int, best: float, hidden: int = 0) -> list[float]:
        """:param best: best score of a candidate."""
        return [*self.rare(read, hidden), len(read), float(is_odd(read)), float(cap), self.share(n_read), best]

    def scored(self, read: str, known: list[tuple[str, int]], n_read: int) -> list[tuple[str, int, float, float]]:
        """Candidates that are more common than the word and no other way to join it, unless more than three characters changed in a way never learnt: entry, count, score with its count, best such score of the others."""
        rows = [(c, n, x + 0.5 * self.share(n)) for c, n in sorted(known) if n > n_read and c.replace("-", "") != read.replace("-", "") and (x := self.channel.score(read, c)) >= self.channel.FLOOR - 6]
        top = sorted((x for *_, x in rows), reverse=True)
        return [(c, n, x, (top[1] if len(top) > 1 and x == top[0] else top[0]) if len(top) > 1 else -40.0) for c, n, x in rows]

    def best(self, words: list[tuple[str, list[tuple[str, int]], bool, int]]) -> list[tuple[str | None, float, float]]:
        """For each word, its entries of the lexicon, its capital and its count: the best correction, its probability, and that of being misread without it."""
        rows, owner, names, own = [], [], [], []
        for k, (word, known, cap, n_read) in enumerate(words):
            scored = self.scored(word, known, n_read)
            for c, n, _, others in scored:
                rows.append(self.features(word, c, n, cap, n_read, others))
                owner.append(k)
                names.append(c)
            own.append(self.own_features(word, cap, n_read, max((x for *_, x, _ in scored), default=-40.0)))
        out: list[tuple[str | None, float, float]] = [(None, 0.0, p) for p in self.alone.predict(np.array(own)).tolist()] if own else []
        if rows:
            for k, c, p in zip(owner, names, self.trees.predict(np.array(rows)).tolist()):
                if p > out[k][1]:
                    out[k] = (c, p, out[k][2])
        return out

    def join_features(self, joined: int, other: int, left: int, right: int, word: str, hidden: int = 0) -> list[float]:
        return [self.share(x) for x in (joined, other, left, right)] + list(self.rare(word, hidden))


def payload_texts(payloads: DataFrame) -> DataFrame:
    """payload_id, scanned, text: one row a payload with text."""
    rows = payloads.where("payload_id is not null and markdown is not null and markdown <> ''").select("payload_id", F.coalesce(F.col("extractor_id").isin(*SCANNED), F.lit(False)).alias("scanned"), F.col("markdown").alias("text"))
    return rows.dropDuplicates(["payload_id"])


def _templates(scans: DataFrame) -> tuple[set[str], set[str]]:
    """Lines of the corpus only at edges of pages (stamps), and lines within pages that are headings."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_edge, within = Counter(), Counter()
            for text in batch.column("text").to_pylist():
                seen = set(Scan(text).edge_lines())
                at_edge.update(t for t, e in seen if e)
                within.update(t for t, e in seen if not e)
            names = sorted(at_edge.keys() | within.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([at_edge[t] for t in names], pa.int64()), pa.array([within[t] for t in names], pa.int64())], names=["line", "at_edge", "within"])

    counted = scans.select("text").mapInArrow(count, "line string, at_edge bigint, within bigint").groupBy("line").agg(F.sum("at_edge").alias("at_edge"), F.sum("within").alias("within"))
    plain = ~F.col("line").rlike(r"[.!?:;,…][\"'»”)]*$") & (F.col("line") != "0")
    stamp = (F.col("at_edge") >= TEMPLATE_PAYLOADS) & (F.col("within") <= 0.03 * F.col("at_edge"))
    head = (F.col("within") >= TEMPLATE_PAYLOADS) & F.col("line").rlike(r"^\p{L}") & ~F.substring("line", -1, 1).isin(*MARKS)
    often = counted.where(plain & (stamp | head)).select("line", stamp.alias("stamp"), head.alias("head")).collect()
    stamps, heads = {r.line for r in often if r.stamp}, {r.line for r in often if r.head}
    return stamps, heads


def _lexicon(texts: DataFrame) -> DataFrame:
    """word, n and cap (never in lower case) of the clean payloads, compounds included."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, link = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*"), re.compile(r"\]\([^)]*\)")
        for batch in batches:
            found: Counter[str] = Counter()
            small: set[str] = set()
            for text in batch.column("text").to_pylist():
                for w, k in Counter(word.findall(link.sub("]", text))).items():
                    found[w.lower()] += k
                    small |= {w} if w[0].islower() else set()
            for w in [w for w in found if "-" in w]:
                for part in w.split("-"):
                    found[part] += found[w]
                    small.add(part)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64()), pa.array([w not in small for w in found], pa.bool_())], names=["word", "n", "cap"])

    counted = lambda df: df.select("text").mapInArrow(words, "word string, n bigint, cap boolean").groupBy("word").agg(F.sum("n").alias("n"), F.min("cap").alias("cap"))
    clean = texts.where("not scanned")
    return counted(clean) if not clean.isEmpty() else counted(texts).where("n >= 5")


@lru_cache(maxsize=1 << 17)
def gram_bucket(gram: str) -> int:
    return xxhash.xxh64_intdigest(gram) % GRAM_BUCKETS


def _sequences(lexicon: DataFrame) -> tuple[np.ndarray, int]:
    """Occurrences in clean text of each sequence of four characters, by hash, and the number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(GRAM_BUCKETS, np.int64)
        words = 0
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                words += 0 if "-" in word else n  # the parts of a compound are counted too
                for g in set(grams(word)):
                    found[gram_bucket(g)] += n
        own = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[own, -1], pa.int64()), pa.array(np.r_[found[own], words], pa.int64())], names=["bucket", "n"])

    summed = lexicon.select("word", "n").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    buckets = np.zeros(GRAM_BUCKETS + 1, np.float32)
    total = 0
    if summed.num_rows:
        at, n = summed["bucket"].to_numpy(), summed["n"].to_numpy()
        buckets[at] = n
        total = int(n[at == -1].sum())
    return buckets[:GRAM_BUCKETS], total


def _keys(word: str) -> list[str]:
    padded = f"^^{word}$$"
    return sorted({padded[i : i + 3] for i in range(len(padded) - 2)})


@lru_cache(maxsize=1 << 16)
def _key_set(word: str) -> frozenset[str]:
    return frozenset(_keys(word))


def _least(size: int) -> int:
    """Keys that a candidate shares with a word of so many keys."""
    return max(1, math.ceil(next(share for over, share in LEAST_SHARED if size > over) * size))


def candidates(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, known: entries of the lexicon that share enough trigrams, by inverted joins.

    The FREQUENT most common entries make an index of bounded size that is
    sent to the words; entries beyond them meet the words by a shuffle.

    :param words: distinct words; :param lexicon: word, n.
    """
    offered = lexicon.where(F.length("word") >= 2)
    ordered = F.struct((-F.col("n")).alias("m"), "word")
    top = offered.select("word", "n", ordered.alias("o")).orderBy("o").limit(FREQUENT).collect()
    found = _indexed(words, [(r.word, r.n) for r in top])
    if len(top) == FREQUENT:
        rest = offered.where((F.col("n") < top[-1].n) | (F.col("n") == top[-1].n) & (F.col("word") > top[-1].word))
        found = found.unionByName(_inverted(words, rest).groupBy("word").agg(F.collect_list(F.struct("entry", "n")).alias("known")))
        found = found.groupBy("word").agg(F.flatten(F.collect_list("known")).alias("known"))
    return found


def _indexed(words: DataFrame, entries: list[tuple[str, int]]) -> DataFrame:
    """word, known by an inverted index of bounded size: the lists of a word's keys are counted at once."""
    spark = words.sparkSession
    lists: dict[str, list[int]] = {}
    for k, (word, _) in enumerate(entries):
        for key in _keys(word):
            lists.setdefault(key, []).append(k)
    index = spark.sparkContext.broadcast((entries, np.array([len(w) for w, _ in entries], np.int32), {key: np.array(v, np.int32) for key, v in lists.items()}))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths, posted = index.value
        for batch in batches:
            out = []
            for word in batch.column("word").to_pylist():
                keys = _keys(word)
                met = [posted[x] for x in keys if x in posted]
                if not met:
                    out.append([])
                    continue
                shared = np.bincount(np.concatenate(met), minlength=len(known))
                near = np.flatnonzero((shared >= _least(len(keys))) & (np.abs(lengths - len(word)) <= 2))
                out.append([{"entry": known[i][0], "n": known[i][1]} for i in near if known[i][0] != word])
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(out, pa.list_(pa.struct([("entry", pa.string()), ("n", pa.int64())])))], names=["word", "known"])

    spread = words.select("word").repartition(shuffle_partitions(spark), "word")
    return spread.mapInArrow(probe, "word string, known array<struct<entry:string,n:bigint>>").where(F.size("known") > 0)


def _inverted(words: DataFrame, offered: DataFrame) -> DataFrame:
    """word, entry, n of close pairs.

    Who shares t of a word's k keys shares at least l of its k - t + l rarest,
    so only those are joined: common trigrams with their long lists stay out.
    """

    @F.pandas_udf("array<string>")
    def keys(batch: pd.Series) -> pd.Series:
        return batch.map(_keys)

    @F.pandas_udf("boolean")
    def close(read: pd.Series, entry: pd.Series) -> pd.Series:
        return pd.Series([len(_key_set(a) & _key_set(b)) >= _least(len(_key_set(a))) for a, b in zip(read, entry)], dtype=bool)

    close = close.asNondeterministic()  # else it would be tested before pairs are made distinct
    posted = offered.select(F.col("word").alias("entry"), "n", F.explode(keys("word")).alias("key"))
    listed = posted.groupBy("key").agg(F.count("*").alias("listed"))
    own = words.select("word").repartition(shuffle_partitions(words.sparkSession), "word").withColumn("keys", keys("word"))
    size = F.size("keys")
    share = F.coalesce(*[F.when(size > over, F.lit(share)) for over, share in LEAST_SHARED])
    least = F.greatest(F.lit(1), F.ceil(share * size))
    asked = own.select("word", size.alias("size"), least.alias("least"), F.explode("keys").alias("key")).join(listed, "key")
    place = F.row_number().over(Window.partitionBy("word").orderBy("listed", "key"))
    shared = F.least(F.col("least"), F.lit(3))
    rarest = asked.withColumn("place", place).where(F.col("place") <= F.col("size") - F.col("least") + shared).select("word", "key", shared.alias("shared"))
    met = rarest.join(posted, "key").where((F.col("word") != F.col("entry")) & (F.abs(F.length("word") - F.length("entry")) <= 2))
    pairs = met.groupBy("word", "entry").agg(F.first("n").alias("n"), F.count("*").alias("met"), F.max("shared").alias("shared"))
    return pairs.where(F.col("met") >= F.col("shared")).where(close("word", "entry")).select("word", "entry", "n")


def _drawn(words: DataFrame, size: int, seed: int) -> DataFrame:
    """About ``size`` words drawn by hash."""
    total = max(1, words.count())
    return words.where(F.pmod(F.xxhash64("word", F.lit(seed)), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, size / total))))


def _scan_words(scans: DataFrame, lexicon: DataFrame, common: float) -> DataFrame:
    """word and n: words of scans with fewer occurrences in clean text, but no names, as these differ from each other by themselves."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {w for text in batch.column("text").to_pylist() for chunk in text.split() if chunk[-1] not in MARKS for w in parts_of(chunk) if 3 <= len(w) <= 40 and any(c.isalpha() for c in w) and not w[0].isupper()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    met = scans.select("text").mapInArrow(words, "word string").distinct().join(lexicon.select("word", "n"), "word", "left")
    return met.select("word", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < common)


def _channel(rare: DataFrame, known: DataFrame) -> Channel:
    """The channel of all words of scans that are rare in clean text.

    :param rare: word, n; :param known: word and its candidates.
    """
    # a word stems from one that clean text has far more often
    stems = F.filter("known", lambda k: k["n"] >= RARER * F.col("n"))
    offered = keep(known.join(rare, "word").select("word", stems.alias("known")).where(F.size("known") > 0), "stems")
    if offered.count() > CHANNEL_WORDS:
        return learn_channel_joined(offered)
    found = offered.orderBy("word").toArrow()
    return learn_channel([(w, [(k["entry"], k["n"]) for k in ks]) for w, ks in zip(found["word"].to_pylist(), found["known"].to_pylist())])


def _fit(channel: Channel, lexicon: DataFrame, frequent: dict[str, int]) -> Speller:
    """Fit the trees on bounded samples of the corpus' own words, sent through the channel."""
    spark = lexicon.sparkSession
    speller = Speller(channel, *_sequences(lexicon))
    rng = np.random.default_rng(11)
    drawn = _drawn(lexicon.where(F.length("word") >= 3), int(1.5 * SAMPLE_WORDS), 13).orderBy("word").limit(2 * SAMPLE_WORDS).collect()
    capital = {r.word: r.cap for r in drawn}
    sample = [(r.word, r.n) for r in drawn if "-" not in r.word and not is_odd(r.word)][:SAMPLE_WORDS]
    compounds = [(r.word, r.n) for r in lexicon.where(F.col("word").rlike("^[^-]+-[^-]+$")).orderBy(F.desc("n"), "word").limit(SAMPLE_WORDS // 3).collect()]
    common = [(w, n) for w, n in sorted(frequent.items(), key=lambda x: (-x[1], x[0])) if "-" not in w and len(w) > 3][:1500]
    few = max(1, SAMPLE_WORDS // 4 // max(1, len(sample)))  # a small lexicon's words are damaged in several ways
    damaged = [(channel.corrupt(w, rng), w, n) for w, n in sample * few + common]
    # some words are read wrong twice
    damaged = [((rng.random() < 0.15 and channel.corrupt(r, rng)) or r, w, n) for r, w, n in damaged if r]
    damaged = [(r, w, n) for r, w, n in damaged if r not in frequent]
    clean = sample * min(few, 10)
    asked = sorted({r for r, _, _ in damaged} | {w for w, _ in clean})
    offered = candidates(spark.createDataFrame([(w,) for w in asked], "word string"), lexicon).toArrow() if asked else pa.table({"word": pa.array([], pa.string())})
    place = {w: k for k, w in enumerate(offered["word"].to_pylist())}

    def known(word: str) -> list[tuple[str, int]]:
        k = place.get(word)
        return [] if k is None else [(e["entry"], e["n"]) for e in offered["known"][k].as_py()]

    def hardest(rows: list[tuple], k: int) -> list[tuple]:
        """The best wrong candidates and some others."""
        rows = sorted(rows, key=lambda r: (-r[2], r[0]))
        return rows[:k] + [rows[k + int(i)] for i in rng.permutation(len(rows) - k)[:2]] if len(rows) > k else rows

    x, y, own_x, own_y = [], [], [], []
    for k, (read, true, n) in enumerate(damaged):
        hidden = k % 3 == 0  # as if the corpus didn't know the true word
        # clean text has misspellings too, far fewer than the word
        n_read = int(rng.integers(0, 1 + max(1, n // RARER))) if k % 4 == 1 and n > 1 else 0
        cap = bool(capital.get(true, False) or rng.random() < 0.1)  # any word may begin a sentence
        scored = speller.scored(read, [(c, m) for c, m in known(read) if not (hidden and c == true)], n_read)
        wrong = [r for r in scored if r[0] != true]
        for c, m, _, others in [*(r for r in scored if r[0] == true), *hardest(wrong, 3)]:
            x.append(speller.features(read, c, m, cap, n_read, others))
            y.append(c == true)
        own_x.append(speller.own_features(read, cap, n_read, max((r[2] for r in scored), default=-40.0)))
        own_y.append(True)
    for k, (w, n) in enumerate(clean):
        n_read = 0 if k % 2 else n  # half of them as words that clean text lacks
        if any(m >= RARER * n and channel.score(w, c) > channel.FLOOR for c, m in known(w)):
            continue  # clean text has misspellings too: this may be one
        scored = speller.scored(w, known(w), n_read)
        cap, hidden = bool(capital[w] or rng.random() < 0.1), n if k % 2 else 0
        for c, m, _, others in hardest(scored, 4):
            x.append(speller.features(w, c, m, cap, n_read, others, hidden))
            y.append(False)
        own_x.append(speller.own_features(w, cap, n_read, max((r[2] for r in scored), default=-40.0), hidden))
        own_y.append(False)
    both = lambda v: bool(v) and any(v) and not all(v)
    nothing = lambda k, v: Boosted(rounds=0).fit(np.array([[0.0] * k, [1.0] * k]), np.array([v, v]))
    speller.trees = Boosted(rounds=60, depth=4).fit(np.array(x), np.array(y, float)) if both(y) else nothing(16, 0.0)
    speller.alone = Boosted(rounds=40, depth=4).fit(np.array(own_x), np.array(own_y, float)) if both(own_y) else nothing(8, 0.0)
    x, y = [], []
    cuts = [(w, n, int(rng.integers(2, len(w) - 1)), rng.random() < 0.3) for w, n in sample + common * 3 if len(w) > 4]
    wanted = {p for w, _, at, _ in cuts for p in (w[:at], w[at:])} | {p for w, _ in compounds for p in (*w.split("-"), w.replace("-", ""))}
    counts = _counts(lexicon, wanted, frequent)
    for w, n, at, unknown in cuts:
        x.append(speller.join_features(0 if unknown else n, 0, counts.get(w[:at], 0), counts.get(w[at:], 0), w, n if unknown else 0))
        y.append(True)
    for w, n in compounds * max(1, 1000 // max(1, len(compounds))):
        a, b = w.split("-")
        unknown = rng.random() < 0.3
        x.append(speller.join_features(counts.get(a + b, 0), 0 if unknown else n, counts.get(a, 0), counts.get(b, 0), a + b))
        y.append(False)
    speller.joins = Boosted(rounds=30).fit(np.array(x), np.array(y, float)) if x and any(y) else nothing(7, 1.0)
    return speller


def _counts(lexicon: DataFrame, words: set[str], frequent: dict[str, int]) -> dict[str, int]:
    """Counts of a bounded number of words; those beyond the dictionary are joined with the lexicon."""
    rest = sorted(words - frequent.keys())
    if not rest:
        return frequent
    asked = lexicon.sparkSession.createDataFrame([(w,) for w in rest], "word string")
    return frequent | {r.word: r.n for r in lexicon.join(F.broadcast(asked), "word", "left_semi").select("word", "n").collect()}


def _part_counts(asks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """asks with n_left and n_right from the whole lexicon where the dictionary lacks the part: joined by a shuffle."""
    left = F.when(F.col("n_left") == 0, F.substring("other", F.lit(1), F.col("left_len")))
    right = F.when(F.col("n_right") == 0, F.expr("substring(other, left_len + 2)"))
    of_join = F.col("role") == "join"
    cut = asks.withColumn("left", F.when(of_join, left)).withColumn("right", F.when(of_join, right))
    asked = cut.select(F.explode(F.array("left", "right")).alias("word")).where("word is not null").distinct()
    parts = keep(asked.join(lexicon, "word").select("word", "n"), "parts")
    for side in ("left", "right"):
        cut = cut.join(parts.select(F.col("word").alias(side), F.col("n").alias(f"{side}_n")), side, "left")
        cut = cut.withColumn(f"n_{side}", F.coalesce(f"{side}_n", f"n_{side}")).drop(side, f"{side}_n")
    return cut.select(*asks.columns)


ASKS = "payload_id {kind}, line_no int, next_no int, role string, word string, other string, left_len int, cap boolean, n_left bigint, n_right bigint"


def find_noise(payloads: DataFrame) -> DataFrame:
    """Every noisy place: payload_id, line_no, next_no, defect (furniture, hyphen, compound, misread), word, fixed, left_len.

    compound rows stand for words that are joined with their hyphen; fixed is
    null where a misread word has no good correction. Of a misread word that is
    cut, next_no is the line of its other part.
    """
    spark = payloads.sparkSession
    bounded_batches(spark)
    texts = keep(payload_texts(payloads), "texts")
    scans = texts.where("scanned")
    lexicon = keep(_lexicon(texts), "lexicon")
    total = lexicon.where(~F.col("word").contains("-")).agg(F.sum("n")).first()[0] or 0
    # words of at least two occurrences and that share of the text: no more than FREQUENT, but for compounds
    common = max(2, COMMON_SHARE * total)
    frequent = {r.word: r.n for r in lexicon.where(F.col("n") >= common).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()}
    stamps, heads = _templates(scans)
    rare = keep(_scan_words(scans, lexicon, common), "rare")
    known = keep(candidates(rare.select("word"), lexicon), "known")
    fitted = _fit(_channel(rare, known), lexicon, frequent)
    speller = spark.sparkContext.broadcast(fitted)
    digits = fitted.channel.digits()
    drawn = scans.where(F.length("text") <= SAMPLE_CHARS).select(F.xxhash64("text", F.lit(19)).alias("place"), "text").orderBy("place", "text").limit(SAMPLE_SCANS).collect()
    furniture_trees = fit_furniture([r.text for r in drawn], stamps, heads, digits)
    shared = spark.sparkContext.broadcast((frequent, stamps, heads, digits, furniture_trees))
    kind = dict(payloads.dtypes)["payload_id"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, edge, inner, digits, trees = shared.value
        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
        for batch in batches:
            rows, out = [], []
            parsed = [Scan(text, edge, inner, digits) for text in batch.column("text").to_pylist()]
            peel_all(parsed, trees)
            for i, scan in enumerate(parsed):
                mine = [(no, None, "furniture", None, None, None, None, None, None) for no in sorted(scan.furniture)] + list(line_asks(scan, known))
                out += mine
                rows += [i] * len(mine)
            cols = list(zip(*out)) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays([batch.column("payload_id").take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["payload_id", "line_no", "next_no", "role", "word", "other", "left_len", "cap", "n_left", "n_right"])

    asks = keep(scans.select("payload_id", "text").mapInArrow(ask, ASKS.format(kind=kind)), "asks")
    words = asks.where("role <> 'furniture'").select(F.explode(F.array("word", "other")).alias("word"), "cap").where("word is not null").groupBy("word").agg(F.min("cap").alias("cap"))
    counted = keep(words.join(lexicon.drop("cap"), "word", "left"), "counted")
    # words that the channel was learnt from have their candidates
    others = keep(counted.select("word").join(rare.select("word"), "word", "left_anti"), "others")
    offered = counted.join(known.unionByName(candidates(others, lexicon)), "word", "left")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = speller.value.best([(w, [(k["entry"], k["n"]) for k in ks or []], c, n or 0) for w, ks, c, n in zip(*(batch.column(x).to_pylist() for x in ("word", "known", "cap", "n")))])
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), *[pa.array([b[k] for b in best], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64()))]], names=["word", "n", "fixed", "p", "odd"])

    verdicts = keep(offered.select("word", "n", "known", "cap").mapInArrow(rank, "word string, n bigint, fixed string, p double, odd double"), "verdicts")
    about = lambda c: verdicts.select(F.col("word").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("n", "fixed", "p", "odd")])
    sized = _part_counts(asks, lexicon)
    judged = sized.where("role <> 'furniture'").join(about("word"), "word").join(about("other"), "other", "left")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = speller.value
        for batch in batches:
            rows, out = [], []
            asked = batch.select(["line_no", "next_no", "role", "word", "other", "left_len", "n_left", "n_right", "word_n", "word_fixed", "word_p", "word_odd", "other_n", "other_fixed", "other_p", "other_odd"]).to_pylist()
            split = [i for i, r in enumerate(asked) if r["role"] == "join"]
            forms = [s.join_features(r["word_n"] or 0, r["other_n"] or 0, r["n_left"], r["n_right"], r["word_fixed"] if (r["word_p"] or 0) >= 0.5 else r["word"]) for r in (asked[i] for i in split)]
            compound = dict(zip(split, (s.joins.predict(np.array(forms)) < 0.5).tolist())) if split else {}
            for i, r in enumerate(asked):
                for row in _decide(r, compound.get(i, False)):
                    rows.append(i)
                    out.append(row)
            cols = list(zip(*out)) if out else [[]] * 6
            types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column("payload_id").take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["payload_id", "line_no", "next_no", "defect", "word", "fixed", "left_len"])

    schema = f"payload_id {kind}, line_no int, next_no int, defect string, word string, fixed string, left_len int"
    nothing = {"next_no": "int", "word": "string", "fixed": "string", "left_len": "int"}
    furniture = asks.where("role = 'furniture'").select("payload_id", "line_no", F.lit("furniture").alias("defect"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    return furniture.unionByName(judged.mapInArrow(decide, schema)).select("payload_id", "line_no", "next_no", "defect", "word", "fixed", "left_len")


def _decide(r: dict, compound: bool) -> Iterator[tuple]:
    """Defects of one looked-up word: line, next line, defect, word, fixed, length of the left part."""
    word = r["word"]

    def misread(c: str) -> tuple[bool, str | None]:
        good = r[f"{c}_fixed"] if (r[f"{c}_p"] or 0) >= 0.5 else None
        return good is not None or (r[f"{c}_odd"] or 0) >= 0.5, good

    bad, fixed = misread("word")
    if r["role"] == "word":
        if bad:
            yield r["line_no"], None, "misread", word, fixed, r["left_len"]
        return
    if not r["word_n"] and not r["other_n"]:
        # neither form is known: the one with the better correction
        a, b = r["word_p"] or 0, r["other_p"] or 0
        if max(a, b) >= 0.5:
            compound = b > a
    if compound:
        bad, fixed = misread("other")
        if not r["other_n"] and r["n_left"] and r["n_right"]:
            bad = False
    yield r["line_no"], r["next_no"], "compound" if compound else "hyphen", word, None, r["left_len"]
    if bad:
        at = differing(word, (fixed or "").replace("-", ""))[2] if fixed else next((i for i, c in enumerate(word) if is_odd(c)), 0)
        right = at >= r["left_len"]
        yield (r["next_no"], r["line_no"], "misread", r["other"] if compound else word, fixed, r["left_len"]) if right else (r["line_no"], r["next_no"], "misread", r["other"] if compound else word, fixed, r["left_len"])


def noise_rows(found: DataFrame) -> DataFrame:
    """payload_id, line_no, defect: each once."""
    return found.where("defect <> 'compound'").select("payload_id", "line_no", "defect").distinct()


def repair_text(payloads: DataFrame, found: DataFrame) -> DataFrame:
    """payload_id, text: paragraphs of running text without furniture, with words joined and corrected.

    Headings, anchors and rows of tables keep their own lines.
    """
    spark = payloads.sparkSession
    places = found.groupBy("payload_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "next_no", "defect", "word", "fixed", "left_len"))).alias("places"))
    scans = payload_texts(payloads).where("scanned").join(places, "payload_id", "left")
    kind = dict(payloads.dtypes)["payload_id"]
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [repaired(t, p or []) for t, p in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("payload_id"), pa.array(done, pa.string())], names=["payload_id", "text"])

    return scans.select("payload_id", "text", "places").mapInArrow(run, f"payload_id {kind}, text string")


def _with_case(read: str, fixed: str) -> str:
    return fixed.upper() if read.isupper() and len(read) > 1 else fixed[:1].upper() + fixed[1:] if read[:1].isupper() else fixed


def repaired(text: str, places: list[dict]) -> str:
    furniture = {p["line_no"] for p in places if p["defect"] == "furniture"}
    joins = {p["line_no"]: p["defect"] for p in places if p["defect"] in ("hyphen", "compound")}
    fixes: dict[int, dict[str, str]] = {}  # of a line
    seams: dict[int, dict[str, str]] = {}  # of the word that a line's end cuts
    for p in places:
        if p["defect"] == "misread" and p.get("fixed"):
            cut = p.get("next_no") is not None
            (seams if cut else fixes).setdefault(min(p["line_no"], p["next_no"]) if cut else p["line_no"], {})[p["word"]] = p["fixed"]
    out: list[str] = []
    current, pending, open_no, gap = "", "", 0, False
    for no, line in enumerate(text.split("\n"), 1):
        s = line.strip()
        if no in furniture or ANCHOR.match(s):
            continue
        if no in fixes:
            s = _corrected(s, fixes[no])
        if not s:
            gap = True
            continue
        # a blank line parts paragraphs, but not where furniture or a new page cut a sentence
        runs_on = bool(current) and (bool(pending) or not gap or not re.search(r"[.!?:][\"'»”)]*$", current) and s[:1].islower())
        short = len(s) < 40 and not END.search(s) and s[-1] not in MARKS
        if s.startswith("#") or (short and gap and not runs_on):
            if current:
                out.append(current)
            out.append(s)
            current, pending, gap = "", "", False
            continue
        if current and not runs_on:
            out.append(current)
            current = ""
        if pending and open_no in seams:
            # the cut word alone: from its beginning to the end of its other part
            at, end = current.rfind(" ") + 1, (s + " ").find(" ")
            current = current[:at] + _corrected(current[at:] + s[:end], seams[open_no]) + s[end:]
        else:
            current = current + s if pending else f"{current} {s}" if current else s
        pending, open_no = joins.get(no, ""), no
        if pending == "hyphen":
            current = current.rstrip(MARKS)
        elif pending == "compound":
            current = current.rstrip(MARKS) + "-"
        gap = False
    if current:
        out.append(current)
    return "\n\n".join(out)


def _corrected(text: str, fixes: dict[str, str]) -> str:
    pattern = "(?<![^\\W_])(" + "|".join(re.escape(w) for w in sorted(fixes, key=len, reverse=True)) + ")(?![^\\W_])"
    return re.sub(pattern, lambda m: _with_case(m[0], fixes.get(m[0].lower(), m[0])), text, flags=re.IGNORECASE)
