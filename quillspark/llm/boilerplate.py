"""Main content of web pages by a suffix array of each host's pages.

The pages of a host are concatenated to one stream of tokens in which line ends
and the separators of menus are boundaries, with a different end mark after each
page. The stream's suffix array and the lengths of common prefixes give what
several pages share: whole units between two boundaries (a line, an item of a
menu), and any substring of LONG_TOKENS or more. Hosts of few pages repeat
little, so they are pooled to one stream in which what several hosts share
counts as well. Large hosts are cut into blocks and the small ones into pools.
What is frequent in one of the blocks is counted exactly over all of them by the
hash of its tokens: what is frequent as a whole is so in at least one block. Every
block is then matched with what the host, or all pools together, repeat.

What is repeated is boilerplate, unique runs are kept, and an outline corrects
this: repeated headings over text that is kept, tables with a row of their own
and short stock sentences amid the article stay; lines that stand among repeated
ones (titles of other pages in a list under a repeated heading, a notice that
only one page has) go. A run of lines in which nothing is repeated is never
removed. Notices are told from sentences by word weights that are learnt from a
bounded sample of the repeated sentences around articles and the unique ones
within.

Defined results: null, empty and blank texts have no lines and give no row;
blank lines are never reported; a page without a heading begins with its first
sentence; repeated rows of a payload count once; a page whose captures name
several hosts belongs to the least of them; pages of one text count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.keys import BLANKS
from quillspark.session import bounded_batches, keep

BLOCK_BYTES = 2 << 20
BLOCK_PAGES = 200  # pages that a block of a large host has at least on average
POOL_BELOW = 128 << 10  # hosts with less text than this are pooled
LONG_TOKENS = 20  # least length of a repeated substring that is boilerplate, boundaries included
COVERED = 0.8  # share of a sentence's or heading's tokens that is repeated
ALL_POOLS = "all pools"  # scope of what the small hosts repeat over all pools
FILTER_BITS = 1 << 26  # hashes to count again are looked up in a table of so many bits first; the join that follows is exact
SAMPLE_PAGES = 3000
SAMPLE_CHARS = 100_000  # pages as long as this aren't drawn for the sample
TOKEN = re.compile(r"\w+")
LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
BOUNDARY = re.compile(r"[|·•>›/–—:.©]|\s-\s|\s{2,}")
HEADING, BULLET = re.compile(r"#{1,6}\s+\S"), re.compile(r"(?:[-*+•]|\d+[.)])\s+")
SENTENCE_END = re.compile(r"[.!?。…][\"'»”’]*(?:\[\^[^\]]*\])?$")


def host_of(url: Column) -> Column:
    """Host in its plain spelling: lower case, without user, port, last dot and leading www."""
    rest = F.regexp_replace(F.lower(F.btrim(url, F.lit(BLANKS))), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@|:\d*$", "")
    return F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")


def plain(line: str) -> str:
    return LINK.sub(r"\1", line.strip())


def kind_of(line: str) -> str:
    """Table, heading, bullet, link, sentence or label."""
    raw = line.strip()
    if raw.startswith("|"):
        return "table"
    if HEADING.match(raw):
        return "heading"
    if BULLET.match(raw):
        return "bullet"
    if not LINK.sub("", raw).strip(" |·•>/-–—,") and LINK.search(raw):
        return "link"
    text = plain(line)
    if text.startswith("©"):
        return "label"
    words, wide = len(text.split()), sum(c > "⺀" for c in text)  # scripts without spaces
    if SENTENCE_END.search(text) and (words >= 4 or wide >= 8) or words >= 24:
        return "sentence"
    return "label"


def units_of(line: str, kind: str) -> list[list[str]]:
    """Words between boundaries, numbers put alike; a sentence is one unit."""
    raw = line.strip()
    if kind == "bullet":
        raw = BULLET.sub("", raw, count=1)
    if kind == "sentence":
        pieces = [plain(raw)]
    else:
        pieces = BOUNDARY.split(LINK.sub(r"|\1|", raw))
    found = [["0" if w.isdigit() else w for w in TOKEN.findall(p)] for p in pieces]
    return [w for w in found if w]


def suffix_array(tokens: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes and length of the common prefix with the one before, both up to at least ``longest`` tokens.

    Prefix doubling: ranks of all substrings of length 1, 2, 4 ... are kept and
    give the common lengths by descending through them.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    ranks, length = [rank], 1
    while length < longest:
        follow = np.zeros(n, np.int64)
        follow[: n - length] = rank[length:] + 1
        rank = np.unique(rank * (n + 2) + follow, return_inverse=True)[1].astype(np.int64)
        ranks.append(rank)
        length *= 2
        if rank.max() == n - 1:
            break
    order = np.argsort(rank, kind="stable")
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        inside = (left < n) & (right < n)
        same = np.zeros(n - 1, bool)
        same[inside] = ranks[j][left[inside]] == ranks[j][right[inside]]
        # a rank beyond the stream's end stands for a shorter suffix, which no other equals
        step = np.where(same, 1 << j, 0)
        common += step
        left, right = left + step, right + step
    return order, np.r_[0, common]


def often(pages: int) -> int:
    """Pages of so many that make what they share a repetition."""
    return max(3, math.ceil(0.02 * pages))


def often_hosts(hosts: int, tokens: int) -> int:
    """Hosts of a pool that make what they share a repetition; copies of an article reach some, so that long substrings need more."""
    return max(8, math.ceil(0.05 * hosts)) if tokens >= LONG_TOKENS else max(3, math.ceil(0.01 * hosts))


def least_in_one(needed: int, blocks: int) -> int:
    """What at least one of the blocks has if they have so many together."""
    return -(-needed // blocks)


def _hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words))


class Stream:
    """The pages of a block as one stream of tokens; 0 is a boundary."""

    def __init__(self, pages: list[list[str]]) -> None:
        ids: dict[str, int] = {}
        names: list[int] = [0]
        stream: list[int] = []
        at: list[int] = []
        unit_line: list[int] = []
        unit_start: list[int] = []
        unit_size: list[int] = []
        units: dict[tuple, int] = {}
        unit_id: list[int] = []
        self.lines = sum(map(len, pages))
        line = 0
        for p, own in enumerate(pages):
            stream.append(0)
            for s in own:
                for words in units_of(s, kind_of(s)):
                    unit_line.append(line)
                    unit_start.append(len(stream))
                    unit_size.append(len(words))
                    unit_id.append(units.setdefault(tuple(words), len(units)))
                    for w in words:
                        k = ids.get(w)
                        if k is None:
                            k = ids[w] = len(ids) + 1
                            names.append(xxhash.xxh64_intdigest(w))
                        stream.append(k)
                    stream.append(0)
                line += 1
            stream.append(-1 - p)
            at += [p] * (len(stream) - len(at))
        self.tokens, self.page = np.array(stream, np.int64), np.array(at, np.int64)
        self.unit_line, self.unit_start, self.unit_size = (np.array(x, np.int64) for x in (unit_line, unit_start, unit_size))
        self.unit_id = np.array(unit_id, np.int64)
        # units without a letter (years, rules of tables) say nothing; their hash is none's
        self.unit_hash = np.array([_hash(list(u)) if any(w != "0" for w in u) else 0 for u in units], np.uint64)
        self._names = np.array(names, np.uint64)

    def window_hashes(self) -> np.ndarray:
        """Hash of the LONG_TOKENS tokens from each place on; 0 where the page ends before."""
        n = len(self.tokens)
        value = np.where(self.tokens > 0, self._names[np.maximum(self.tokens, 0)], np.uint64(0x9E3779B97F4A7C15))
        out = np.zeros(n, np.uint64)
        if n < LONG_TOKENS:
            return out
        total = np.zeros(n - LONG_TOKENS + 1, np.uint64)
        for j in range(LONG_TOKENS):
            total = total * np.uint64(0x100000001B3) + value[j : n - LONG_TOKENS + 1 + j]
        ends = np.r_[0, np.cumsum(self.tokens < 0)]
        whole = ends[LONG_TOKENS:] == ends[: n - LONG_TOKENS + 1]
        out[: n - LONG_TOKENS + 1] = np.where(whole, total, 0)
        return out


def shared(pages: list[list[str]], owners: list[int], least: Callable[[int], int]) -> dict[int, int]:
    """What pages share, by suffix array: the hashes of units and long substrings with the number of owners that have them."""
    return {h: n for h, (n, _) in shared_sizes(pages, owners, least).items()}


def shared_sizes(pages: list[list[str]], owners: list[int], least: Callable[[int], int]) -> dict[int, tuple[int, int]]:
    """What pages share: hash, number of owners, and tokens.

    :param owners: the owner of each page; pages of one owner count once.
    :param least: owners that must share a substring of so many tokens.
    """
    s = Stream(pages)
    out: dict[int, tuple[int, int]] = {}
    if not len(s.unit_start):
        return out
    order, common = suffix_array(s.tokens, max(LONG_TOKENS, int(s.unit_size.max()) + 2))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    windows = s.window_hashes()

    owner = np.array(owners, np.int64)

    def report(at: np.ndarray, length: int, tokens: int, hashes: np.ndarray) -> None:
        group = np.cumsum(common < length)[place[at]]
        pairs = np.unique(group * len(pages) + owner[s.page[at]])
        counts = np.unique(pairs // len(pages), return_counts=True)[1]
        first = np.unique(group, return_index=True)[1]
        many = counts >= least(tokens)
        out.update((h, (n, tokens)) for h, n in zip(hashes[first[many]].tolist(), counts[many].tolist()))

    # a unit is its tokens between two boundaries; what shares them is such a unit itself
    for size in np.unique(s.unit_size):
        own = np.flatnonzero(s.unit_size == size)
        report(s.unit_start[own] - 1, int(size) + 2, int(size), s.unit_hash[s.unit_id[own]])
    report(np.flatnonzero(windows), LONG_TOKENS, LONG_TOKENS, windows[windows > 0])
    out.pop(0, None)
    return out


def occurring(pages: list[list[str]], owners: list[int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of units and long substrings whose bit is set, and the number of owners that have them."""
    s = Stream(pages)
    windows = s.window_hashes()
    units = s.unit_hash[s.unit_id] if len(s.unit_id) else np.zeros(0, np.uint64)
    hashes = np.r_[units, windows]
    owner = np.array(owners, np.int64)[np.r_[s.page[s.unit_start] if len(s.unit_id) else np.zeros(0, np.int64), s.page]]
    place = (hashes % np.uint64(FILTER_BITS)).astype(np.int64)
    wanted = (hashes > 0) & (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
    hashes, owner = hashes[wanted], owner[wanted]
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return np.unique(hashes[new], return_counts=True)


def coverage(pages: list[list[str]], known: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each page and line: the share of its words that the given hashes cover, and whether they have a unit of it.

    :param known: sorted hashes a page.
    """
    s = Stream(pages)
    n = len(s.tokens)
    windows = s.window_hashes()
    hit_unit, hit_window = np.zeros(len(s.unit_id), bool), np.zeros(n, bool)
    unit_page = s.page[s.unit_start] if len(s.unit_id) else np.zeros(0, np.int64)
    page_cut, unit_cut = np.searchsorted(s.page, np.arange(len(pages) + 1)), np.searchsorted(unit_page, np.arange(len(pages) + 1))
    hashes = s.unit_hash[s.unit_id] if len(s.unit_id) else np.zeros(0, np.uint64)
    for p, mine in enumerate(known):
        if len(mine):
            for values, hit, cut in ((hashes, hit_unit, unit_cut), (windows, hit_window, page_cut)):
                own = values[cut[p] : cut[p + 1]]
                spot = np.minimum(np.searchsorted(mine, own), len(mine) - 1)
                hit[cut[p] : cut[p + 1]] = (mine[spot] == own) & (own > 0)
    edge = np.zeros(n + 1, np.int64)
    many = np.flatnonzero(hit_window)
    np.add.at(edge, many, 1)
    np.add.at(edge, np.minimum(many + LONG_TOKENS, n), -1)
    inside = np.r_[0, np.cumsum(np.cumsum(edge)[:n] > 0)]
    by_window = inside[s.unit_start + s.unit_size] - inside[s.unit_start]
    words = np.bincount(s.unit_line, s.unit_size, s.lines)
    covered = np.bincount(s.unit_line, np.where(hit_unit, s.unit_size, by_window), s.lines)
    share, touched = covered / np.maximum(words, 1), np.bincount(s.unit_line, hit_unit, s.lines) > 0
    out, at = [], 0
    for own in pages:
        out.append((share[at : at + len(own)], touched[at : at + len(own)]))
        at += len(own)
    return out


def _lines(text: str) -> list[tuple[int, str]]:
    return [(k, s) for k, s in enumerate(text.split("\n"), 1) if s.strip()]


def _blocks(pages: DataFrame) -> DataFrame:
    """payload_id, host, text, block, small (in a pool); the host's distinct texts and blocks (cuts), the number of pools and of hosts in them."""
    sizes = pages.groupBy("host").agg(F.sum(F.length("text")).alias("bytes"), F.count_distinct(F.xxhash64("text")).alias("texts"))
    small = F.col("bytes") < POOL_BELOW
    # by size, but so that a block has many pages; a host's pages are spread evenly by hash
    cuts = F.greatest(F.lit(1), F.least(F.ceil(F.col("bytes") / BLOCK_BYTES), F.ceil(F.col("texts") / BLOCK_PAGES)))
    sizes = sizes.select("host", "texts", small.alias("small"), F.when(small, F.lit(1)).otherwise(cuts).cast("int").alias("cuts"), "bytes")
    pooled, hosts = sizes.where("small").agg(F.sum("bytes"), F.count("*")).first()
    pools = max(1, math.ceil((pooled or 0) / BLOCK_BYTES))
    pool = F.concat(F.lit("pool "), F.pmod(F.xxhash64("host"), F.lit(pools)))
    part = F.pmod(F.xxhash64("text", F.lit(3)), F.col("cuts"))  # copies of a text meet
    placed = pages.join(sizes.drop("bytes"), "host").withColumns({"pools": F.lit(pools), "pool_hosts": F.lit(hosts)})
    return placed.withColumn("block", F.when(F.col("small"), pool).otherwise(F.concat(F.lit("host "), "host", F.lit(" "), part)))


def _owners(pages: list[list[str]]) -> list[int]:
    """Number of each page's text: copies have the same."""
    texts_of: dict[tuple, int] = {}
    return [texts_of.setdefault(tuple(own), len(texts_of)) for own in pages]


def _hash_table(rows: list[tuple], names: list[str]) -> pa.Table:
    """scope, hash and numbers."""
    cols = list(zip(*rows)) if rows else [()] * (2 + len(names))
    unsigned = np.array(cols[1], np.uint64).view(np.int64)
    return pa.table({"scope": pa.array(cols[0], pa.string()), "hash": pa.array(unsigned, pa.int64())} | {c: pa.array(v, pa.int64()) for c, v in zip(names, cols[2:])})


def host_repeats(placed: DataFrame) -> DataFrame:
    """scope and hash of all that a host (scope: its name), a pool of hosts (its block) or all pools together repeat.

    A scope in one block is judged there. A scope of several blocks is judged by
    the exact sum over all its blocks: of what reaches the needed number as a
    whole at least one block has its part of it (needed / blocks) and reports
    it. Where the reports alone leave open whether the number is reached, every
    block is counted again, down to what a single page of a block has.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("payload_id")
        pages = [[s for _, s in _lines(t)] for t in group["text"].to_pylist()]
        hosts, texts, cuts = (group[c].to_pylist() for c in ("host", "texts", "cuts"))
        names = sorted(set(hosts))
        rows: list[tuple] = []
        if group["small"][0].as_py():
            number = {h: k for k, h in enumerate(names)}
            block, pools, pool_hosts = (group[c][0].as_py() for c in ("block", "pools", "pool_hosts"))
            part = lambda tokens: least_in_one(often_hosts(pool_hosts, tokens), pools)
            for h, (n, tokens) in shared_sizes(pages, [number[h] for h in hosts], lambda tokens: min(often_hosts(len(names), tokens), part(tokens))).items():
                if n >= often_hosts(len(names), tokens):
                    rows.append((block, h, n, n, 1))
                if pools > 1 and n >= part(tokens):
                    rows.append((ALL_POOLS, h, n, often_hosts(pool_hosts, tokens), pools))
        for h in names:
            own = [k for k, x in enumerate(hosts) if x == h]
            enough, blocks = often(texts[own[0]]), cuts[own[0]]
            least = least_in_one(enough, blocks)
            if len(own) >= least:
                mine = [pages[k] for k in own]
                rows += [(h, x, n, enough, blocks) for x, n in shared(mine, _owners(mine), lambda tokens, least=least: least).items()]
        return _hash_table(rows, ["n", "needed", "blocks"])

    kept = placed.select("block", "payload_id", "host", "text", "texts", "small", "cuts", "pools", "pool_hosts")
    found = kept.groupBy("block").applyInArrow(run, "scope string, hash bigint, n bigint, needed bigint, blocks bigint")
    reported = keep(found.groupBy("scope", "hash").agg(F.sum("n").alias("n"), F.max("needed").alias("needed"), F.max("blocks").alias("blocks"), F.count("*").alias("reports")), "reported")
    # a block that doesn't report has less than its part
    most = F.col("n") + (F.col("blocks") - F.col("reports")) * (F.ceil(F.col("needed") / F.col("blocks")) - 1)
    sure = reported.where("n >= needed").select("scope", "hash")
    unsure = reported.where((F.col("n") < F.col("needed")) & (most >= F.col("needed"))).select("scope", "hash", "needed")
    return sure.unionByName(_counted_again(placed, unsure))


def _counted_again(placed: DataFrame, unsure: DataFrame) -> DataFrame:
    """scope and hash of what all blocks of its scope together have as often as needed."""
    spark = placed.sparkSession
    places = unsure.select(F.pmod("hash", F.lit(FILTER_BITS)).alias("place")).distinct().toArrow()["place"].to_numpy()
    if not len(places):
        return unsure.select("scope", "hash")
    filled = np.zeros(FILTER_BITS, bool)
    filled[places] = True
    bits = spark.sparkContext.broadcast(np.packbits(filled, bitorder="little"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("payload_id")
        pages = [[s for _, s in _lines(t)] for t in group["text"].to_pylist()]
        scope, hosts = group["scope"][0].as_py(), group["host"].to_pylist()
        number = {h: k for k, h in enumerate(sorted(set(hosts)))}
        hashes, counts = occurring(pages, [number[h] for h in hosts] if group["small"][0].as_py() else _owners(pages), bits.value)
        return pa.table({"scope": pa.array([scope] * len(hashes), pa.string()), "hash": pa.array(hashes.view(np.int64), pa.int64()), "n": pa.array(counts, pa.int64())})

    scoped = placed.select("block", "payload_id", "host", "text", "small", F.when(F.col("small"), F.lit(ALL_POOLS)).otherwise(F.col("host")).alias("scope"))
    scoped = scoped.join(unsure.select("scope").distinct(), "scope", "left_semi")
    counted = scoped.groupBy("block").applyInArrow(run, "scope string, hash bigint, n bigint").join(unsure, ["scope", "hash"])
    return counted.groupBy("scope", "hash").agg(F.sum("n").alias("n"), F.max("needed").alias("needed")).where("n >= needed").select("scope", "hash")


def line_repeats(placed: DataFrame, repeats: DataFrame) -> DataFrame:
    """payload_id, text, and line_no, share, touched: arrays over the non-blank lines.

    Each block gets the hashes of its scopes. They are few: of what is on 2 % of
    the pages there is at most fifty times a page's length. What all pools repeat
    is on 1 % of the small hosts, at most a hundred times such a host's length,
    and is sent to all.
    """
    everywhere = np.sort(repeats.where(F.col("scope") == ALL_POOLS).select("hash").toArrow()["hash"].to_numpy().view(np.uint64))
    common = placed.sparkSession.sparkContext.broadcast(everywhere)
    scopes = placed.select("block", F.explode(F.when(F.col("small"), F.array("block", "host")).otherwise(F.array("host"))).alias("scope")).distinct()
    sent = repeats.join(scopes, "scope").select(F.col("block").alias("to"), "scope", "hash")
    kind = dict(placed.dtypes)["payload_id"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        numbered = [_lines(t) for t in left["text"].to_pylist()]
        scope = np.array(right["scope"].to_pylist(), object)
        hashes = right["hash"].to_numpy().view(np.uint64) if right.num_rows else np.zeros(0, np.uint64)
        order = np.argsort(scope, kind="stable")
        names, starts = np.unique(scope[order].astype(str), return_index=True) if len(order) else ([], [])
        parts = dict(zip(names, np.split(hashes[order], list(starts[1:])))) if len(order) else {}
        sets: dict[tuple, np.ndarray] = {}
        known = []
        for block, host, small in zip(left["block"].to_pylist(), left["host"].to_pylist(), left["small"].to_pylist()):
            if (block, host) not in sets:
                sets[block, host] = np.unique(np.concatenate([parts.get(host, hashes[:0]), parts.get(block, hashes[:0]), common.value if small else hashes[:0]]))
            known.append(sets[block, host])
        got = coverage([[s for _, s in own] for own in numbered], known) if numbered else []
        return pa.table(
            {
                "payload_id": left["payload_id"],
                "text": left["text"],
                "line_no": pa.array([[k for k, _ in own] for own in numbered], pa.list_(pa.int32())),
                "share": pa.array([g[0].tolist() for g in got], pa.list_(pa.float32())),
                "touched": pa.array([g[1].tolist() for g in got], pa.list_(pa.bool_())),
            }
        )

    pages = placed.select("block", "payload_id", "host", "text", "small")
    return pages.groupBy("block").cogroup(sent.groupBy("to")).applyInArrow(run, f"payload_id {kind}, text string, line_no array<int>, share array<float>, touched array<boolean>")


class Outline:
    """The non-blank lines of a page with their kinds, what of them is repeated, and the place of the title."""

    def __init__(self, lines: list[str], share: list[float], touched: list[bool], weights: dict[str, float] | None = None) -> None:
        self.weights = weights
        self.text = [plain(s) for s in lines]
        self.words = [len(t.split()) for t in self.text]
        self.kind = [kind_of(s) for s in lines]
        # a menu or a line of labels is given away by one item, a sentence or heading must be repeated as such
        self.repeated = [c >= COVERED if k in ("sentence", "heading", "table", "bullet") else c >= COVERED or t for k, c, t in zip(self.kind, share, touched)]
        self.title = self._title()

    def _opens(self, k: int) -> bool:
        """A sentence of the page's own that is no notice; while the weights are unknown, one too long for a notice."""
        if self.kind[k] != "sentence" or self.repeated[k]:
            return False
        return self.words[k] >= 36 if self.weights is None else self.words[k] >= 9 and not is_notice(self.text[k], self.weights)

    def _title(self) -> int:
        """The first heading of its own before the first long sentence of its own; without one, what stands right before it."""
        n = len(self.text)
        owners = [t for t in self.text if t.startswith("©")]
        first = next((k for k in range(n) if self._opens(k)), n)
        heads = []
        for k in range(min(first + 1, n)):
            if self.kind[k] == "heading" and (k + 1 == n or self.kind[k + 1] not in ("bullet", "link")):
                name = self.text[k].lstrip("# ").strip()
                if not any(name in o for o in owners):
                    heads.append(k)
        own = [k for k in heads if not self.repeated[k]]
        if own or heads:
            return own[0] if own else heads[-1]
        if first == n:
            first = next((k for k in range(n) if self.kind[k] == "sentence" and not self.repeated[k]), n)
        k = first - 1
        named = 0 <= k < n and any(t != self.text[k] and t.endswith(self.text[k]) for t in self.text[:k])  # by the path of the page
        if 0 <= k < n - 1 and self.kind[k] == "label" and (not self.repeated[k] or named) and self.words[k] >= 2 and not re.search(r"[|·>/]|: ", self.text[k]) and not any(self.text[k] in o for o in owners):
            return k
        return first


def features(text: str) -> set[str]:
    words = [re.sub(r"\d+", "0", w) for w in re.findall(r"\w+", text.lower())]
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:])), *(w + "$" for w in words[-1:]), *("^" + w for w in words[:1])}


def learn_notices(sample: list[tuple[list[str], list[float], list[bool]]]) -> dict[str, float]:
    """Weights of words and pairs of words: how much more they belong to notices than to articles.

    Repeated sentences before the title are notices; those within the article are not.
    """
    notices: Counter[str] = Counter()
    article: Counter[str] = Counter()
    for lines, share, touched in sample:
        o = Outline(lines, share, touched)
        far = [k for k in range(o.title, len(o.kind)) if o.kind[k] == "sentence" and o.words[k] >= 25 and not o.repeated[k]]
        for k, kind in enumerate(o.kind):
            if kind == "sentence":
                if k < o.title < len(o.kind) and o.kind[o.title] == "heading":
                    if o.repeated[k]:
                        notices[o.text[k]] += 1
                elif len(far) > 1 and o.title < k < far[-2]:
                    article[o.text[k]] += 1
    if not notices:
        return {}
    # a line often met counts more, but not in proportion
    yes, no = Counter(), Counter()
    for found, counts in ((notices, yes), (article, no)):
        for text, n in found.items():
            for f in features(text):
                counts[f] += min(n, 20)
    a, b = max(1, sum(min(n, 20) for n in notices.values())), max(1, sum(min(n, 20) for n in article.values()))
    return {f: math.log((yes[f] + 0.2) / (a + 1)) - math.log((no[f] + 0.2) / (b + 1)) for f in yes.keys() | no.keys()}


def is_notice(text: str, weights: dict[str, float]) -> bool:
    if len(text.split()) > 40:
        return False
    known = [weights[f] for f in features(text) if f in weights]
    return sum(known) > 0


def boilerplate_lines(lines: list[str], share: list[float], touched: list[bool], weights: dict[str, float]) -> list[bool]:
    """Which of a page's non-blank lines don't belong to its article."""
    o = Outline(lines, share, touched, weights)
    n = len(o.kind)
    article = [False] * n
    evidence = list(o.repeated)
    k = o.title
    if k < n and o.kind[k] != "sentence":
        article[k] = True
        k += 1
    block_heads = set()
    long_ = [i for i in range(o.title, n) if o.kind[i] == "sentence" and not o.repeated[i] and not is_notice(o.text[i], weights)]
    last_own = max(long_, default=-1)
    while k < n:
        kind, stop = o.kind[k], k + 1
        if kind == "sentence":
            notice = is_notice(o.text[k], weights)
            # a stock sentence: short, repeated, amid the article
            stock = len(TOKEN.findall(o.text[k])) < LONG_TOKENS and (k < last_own or article[k - 1])
            article[k] = not notice and (not o.repeated[k] or stock)
            evidence[k] = not article[k]
        elif kind in ("table", "bullet"):
            while stop < n and o.kind[stop] == kind:
                stop += 1
            rows = range(k, stop)
            if kind == "table":
                good = True  # heads and rules of tables repeat; a table is the host's if every row below them is
                rows = [i for i in rows[1:] if o.text[i].strip("|-: ")]
            else:
                before, size = k - 1, sum(o.words[k:stop]) / (stop - k)
                if before >= 0 and o.kind[before] == "sentence":
                    menu = size < 5 or size < 6 and sum(o.repeated[k:stop]) * 2 > stop - k
                    good = article[before] and not menu
                else:
                    good = size >= 10
                    if not good and before >= 0 and o.kind[before] == "heading":
                        block_heads.add(before)
            article[k:stop] = [good and not (rows and all(o.repeated[i] for i in rows))] * (stop - k)
        k = stop
    last = max((i for i in range(n) if article[i]), default=-1)
    empty = True  # whether the section under a heading has nothing that is kept
    for i in range(n - 1, o.title, -1):
        if o.kind[i] == "heading":
            following = o.kind[i + 1] if i + 1 < n else ""
            article[i] = i < last and i not in block_heads and following != "link" and not (empty and o.repeated[i] and i + 1 < n and o.repeated[i + 1])
            empty = empty or article[i]  # a block of the host amid a section has its own heading
        else:
            empty = empty and not article[i]
    # a run in which nothing is repeated is the page's own
    k = 0
    while k < n:
        stop = k
        while stop < n and not article[stop]:
            stop += 1
        if stop > k and not any(evidence[k:stop]):
            article[k:stop] = [True] * (stop - k)
        k = stop + 1
    return [not a for a in article]


def _pages(pages: DataFrame) -> DataFrame:
    return pages.where("payload_id is not null and text is not null and host is not null").groupBy("payload_id").agg(F.min("host").alias("host"), F.first("text").alias("text"))


def _judged(pages: DataFrame) -> tuple[DataFrame, object]:
    spark = pages.sparkSession
    bounded_batches(spark)
    placed = keep(_blocks(_pages(pages)), "pages")
    known = keep(line_repeats(placed, keep(host_repeats(placed), "shared")), "repeats")
    return known, spark.sparkContext.broadcast(learn_notices(_sample(known)))


def _bad(text: str, line_no: list[int], share: list[float], touched: list[bool], weights: dict[str, float]) -> list[int]:
    lines = text.split("\n")
    return [k for k, b in zip(line_no, boilerplate_lines([lines[k - 1] for k in line_no], share, touched, weights)) if b]


def page_boilerplate(pages: DataFrame) -> DataFrame:
    """payload_id and line_no of every non-blank line outside the article.

    :param pages: payload_id, host, text; repeated payloads count once.
    """
    kind = dict(pages.dtypes)["payload_id"]
    known, weights = _judged(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers = [], []
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "line_no", "share", "touched")))):
                found = _bad(*row, weights.value)
                numbers += found
                rows += [i] * len(found)
            yield pa.RecordBatch.from_arrays([batch.column("payload_id").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32())], names=["payload_id", "line_no"])

    return known.select("payload_id", "text", "line_no", "share", "touched").mapInArrow(run, f"payload_id {kind}, line_no int")


def page_articles(pages: DataFrame) -> DataFrame:
    """payload_id and article: the text without its boilerplate lines, blocks apart by one blank line."""
    kind = dict(pages.dtypes)["payload_id"]
    known, weights = _judged(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("text", "line_no", "share", "touched"))):
                gone = set(_bad(*row, weights.value))
                left = "\n".join("" if k in gone else s.rstrip() for k, s in enumerate(row[0].split("\n"), 1))
                out.append(re.sub(r"\n{3,}", "\n\n", left).strip("\n"))
            yield pa.RecordBatch.from_arrays([batch.column("payload_id"), pa.array(out, pa.string())], names=["payload_id", "article"])

    return known.select("payload_id", "text", "line_no", "share", "touched").mapInArrow(run, f"payload_id {kind}, article string")


def _sample(known: DataFrame) -> list[tuple[list[str], list[float], list[bool]]]:
    """At most about SAMPLE_PAGES pages, drawn by hash, without those of SAMPLE_CHARS characters or more."""
    total = known.count()
    drawn = known if total <= SAMPLE_PAGES else known.where(F.pmod(F.xxhash64("payload_id", F.lit(11)), F.lit(1_000_000)) < F.lit(int(1_000_000 * SAMPLE_PAGES / total)))
    rows = drawn.where(F.length("text") < SAMPLE_CHARS).select("payload_id", "text", "line_no", "share", "touched").orderBy("payload_id").limit(2 * SAMPLE_PAGES).collect()
    out = []
    for r in rows:
        split = r.text.split("\n")
        out.append(([split[k - 1] for k in r.line_no], r.share, r.touched))
    return out


def web_pages(payloads: DataFrame, captures: DataFrame) -> DataFrame:
    """Pages behind captures: payload_id, host, text."""
    hosts = captures.where("payload_id is not null").groupBy("payload_id").agg(F.min(F.coalesce(host_of(F.col("final_url")), F.lit(""))).alias("host"))
    return payloads.where("markdown is not null").select("payload_id", F.col("markdown").alias("text")).join(hosts, "payload_id")
