"""Periodic runs of words, by Kruskal over the suffix array in order of descending common prefix.

A run is a stretch of words with smallest period q, at least ``max(24, 3 * q)`` long, that cannot be
extended.  If it starts at s with length n, then s and s + q agree in just n - q words, and no place
between them agrees with s in as many (else q would not be the smallest period).  So when classes of
suffixes are united by descending common prefix, s and s + q become neighbours in their class's
ordered positions at the step of n - q: every pair that becomes adjacent at distance d and step
m >= 2 * d is a seed, of a run if the word before does not extend it to the left.

n - q is 16 words at least.  So only places whose next ``GRAM`` words occur again in the same text
are sorted: by these words, then by doubling the sorted length until all are told apart.  Equal
ranks at each length give the common prefixes of neighbours.  Classes whose places are all further
apart than half their longest common prefix hold no seed and are left out.  The rest is united by
union-find, the smaller position list going into the larger.

Words are numbered exactly within a text (no hashes); 16-word hashes only choose places to sort.  Texts
are taken together in pieces of about ``PIECE`` words; a longer text is a piece of its own and has to
fit into one task, at some hundred bytes a word.

Null, empty or blank text: no words, no runs, four nulls, hashes of the empty string.  A null
doc_id counts as empty text (crc32 0).  Equal exponents: least start, then least period.  Repeated
rows are documents of their own.  Only doc_id and text are read, so other names cannot clash.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fieldzones.llm import base
from fieldzones.llm.registry import register

LEAST, TIMES = 24, 3
PIECE = 400_000
#: A run of at least LEAST and TIMES periods agrees with itself, one period on, in as many words:
#: n - q >= max(LEAST - q, (TIMES - 1) * q), least where both are equal.
GRAM = min(max(LEAST - q, (TIMES - 1) * q) for q in range(1, LEAST))
#: Places of one block of an ordered position set.
BLOCK = 1024
SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long")


class Places:
    """An ordered set of positions, in blocks."""

    __slots__ = ("blocks", "least", "size")

    def __init__(self, place: int):
        self.blocks, self.least, self.size = [[place]], [place], 1

    def between(self, x: int):
        """The neighbours of ``x``, which is not in the set (None: there is none), and its block."""
        k = max(bisect_left(self.least, x) - 1, 0)
        block = self.blocks[k]
        at = bisect_left(block, x)
        after = block[at] if at < len(block) else self.least[k + 1] if k + 1 < len(self.least) else None
        return (block[at - 1] if at else None), after, k, at

    def add(self, x: int, k: int, at: int) -> None:
        block = self.blocks[k]
        block.insert(at, x)
        self.least[k] = block[0]
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks.insert(k + 1, block[half:])
            self.least.insert(k + 1, block[half])
            del block[half:]

    def __iter__(self):
        return (x for block in self.blocks for x in block)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` words (a power of 2) from each place; those that reach over the end differ from all others."""
    h = base.mix(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = 1
    while step < k:
        after = np.append(h[step:], base.mix(np.arange(1, min(step, len(h)) + 1, dtype=np.uint64) << np.uint64(40)))[:len(h)]
        h = base.mix(h * np.uint64(0x9FB21C651E98DF25) + after)
        step *= 2
    return h


def ranked(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Rank of each member: the place in ``order`` where its group (``new``: begins here) begins."""
    r = np.empty(len(order), np.int64)
    r[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return r


def neighbours(words: np.ndarray):
    """Suffixes that share GRAM words with another: their places in sorted order, and the words that
    each shares with the one before it (0 where fewer than GRAM)."""
    n = len(words)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < GRAM + 1:
        return none
    h = grams(words, GRAM)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    if not again.any():
        return none
    # places GRAM words on are ranked too: the next doubling looks at them
    wanted = again.copy()
    wanted[GRAM:] |= again[:-GRAM]
    place = np.flatnonzero(wanted)
    at = np.full(n + 1, -1, np.int64)
    at[place] = np.arange(len(place))
    ended = np.append(words, np.full(GRAM, -1, words.dtype))
    order = np.arange(len(place))
    for k in range(GRAM - 1, -1, -1):
        order = order[np.argsort(ended[place + k][order], kind="stable")]
    new = np.ones(len(place), bool)
    new[1:] = False
    for k in range(GRAM):
        column = ended[place + k][order]
        new[1:] |= column[1:] != column[:-1]
    levels, size = [(GRAM, ranked(order, new))], GRAM
    while True:
        rank = levels[-1][1]
        many = np.bincount(rank, minlength=len(rank))[rank] > 1
        open_ = np.flatnonzero(many)
        if not len(open_):
            break
        behind = at[np.minimum(place[open_] + size, n)]
        key = np.where(behind >= 0, rank[np.maximum(behind, 0)], -1)
        sub = np.lexsort((key, rank[open_]))
        members, keys = open_[sub], key[sub]
        groups = rank[members]
        first = np.ones(len(members), bool)
        first[1:] = groups[1:] != groups[:-1]
        new = first.copy()
        new[1:] |= keys[1:] != keys[:-1]
        # a member's rank is its group's, moved on by its place in the group
        start = np.maximum.accumulate(np.where(first, np.arange(len(members)), 0))
        begins = np.maximum.accumulate(np.where(new, np.arange(len(members)), 0))
        after = rank.copy()
        after[members] = groups + begins - start
        size *= 2
        levels.append((size, after))
    order = np.argsort(levels[-1][1], kind="stable")
    a, b = order[:-1], order[1:]
    share = np.flatnonzero(levels[0][1][a] == levels[0][1][b])
    pa_, pb = place[a[share]], place[b[share]]
    shared = np.zeros(len(share), np.int64)
    for h_, rank in reversed(levels):
        x, y = at[np.minimum(pa_ + shared, n)], at[np.minimum(pb + shared, n)]
        shared += h_ * ((x >= 0) & (y >= 0) & (rank[x] == rank[y]))
    going = np.arange(len(share))
    for _ in range(GRAM - 1):
        x, y = pa_[going] + shared[going], pb[going] + shared[going]
        going = going[(np.maximum(x, y) < n) & (words[np.minimum(x, n - 1)] == words[np.minimum(y, n - 1)])]
        shared[going] += 1
    lcp = np.zeros(len(order), np.int64)
    lcp[share + 1] = shared
    return place[order], lcp


def seeds(place: np.ndarray, lcp: np.ndarray):
    """(position, distance, common prefix) of places that become adjacent in their class when classes are
    united by descending common prefix, where the prefix is (TIMES - 1) distances at least."""
    if not len(place):
        return
    group = np.cumsum(lcp == 0)
    # the least distance of a class against its longest common prefix
    by = np.lexsort((place, group))
    gap, inside = np.diff(place[by]), np.diff(group[by]) == 0
    least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group[by][1:][inside], gap[inside])
    longest = np.zeros(group[-1] + 1, np.int64)
    np.maximum.at(longest, group, lcp)
    used = (longest > 0) & (least <= longest // (TIMES - 1))
    edge = np.flatnonzero((lcp > 0) & used[group])
    edge = edge[np.argsort(-lcp[edge], kind="stable")]
    above, sets = {}, {}

    def root(i):
        while (up := above.get(i, i)) != i:
            above[i] = i = above.get(up, up)
        return i

    for i, m in zip(edge.tolist(), lcp[edge].tolist()):
        ra, rb = root(i - 1), root(i)
        a = sets.pop(ra, None) or Places(int(place[ra]))
        b = sets.pop(rb, None) or Places(int(place[rb]))
        if a.size < b.size:
            ra, rb, a, b = rb, ra, b, a
        above[rb] = ra
        sets[ra] = a
        put, small = None, list(b)
        for j, x in enumerate(small):
            before, after, k, at = a.between(x)
            # neighbours that come from the small set itself are not new
            if before is not None and before != put and (d := x - before) * (TIMES - 1) <= m:
                yield before, d, m
            if after is not None and (j + 1 == len(small) or small[j + 1] > after) and (d := after - x) * (TIMES - 1) <= m:
                yield x, d, m
            a.add(x, k, at)
            put = x


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in ``words`` (numbers), by start, then period."""
    found = set()
    for s, d, m in seeds(*neighbours(words)):
        if m + d >= max(LEAST, TIMES * d) and (s == 0 or words[s - 1] != words[s - 1 + d]):
            found.add((s, m + d, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id, words: list) -> list:
    """The contract's texts: of every tenth doc_id by crc32, the words from a on repeat the first p of them."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a:a + p]
    return words[:a] + (cycle * (-(-(n - a) // p)))[:n - a]


def collapsed(words: list, found: list) -> list:
    """``words`` without those that a run contains after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, p in found:
        gone[s + p] += 1
        gone[s + n] -= 1
    kept = np.cumsum(gone)[:-1] == 0
    return [w for w, k in zip(words, kept.tolist()) if k]


def summary(doc_id, words: list, found: list) -> tuple:
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = collapsed(words, found)
    listing = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return (doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), len(words), len(words) - len(kept))


def summaries(docs: list[tuple]) -> list[tuple]:
    """Result rows of (doc_id, words) documents, whose words are looked at together."""
    offsets, numbers = [0], []
    for _, words in docs:
        first: dict = {}
        numbers.append(np.fromiter(map(first.setdefault, words, count(offsets[-1])), np.int64, len(words)))
        offsets.append(offsets[-1] + len(words))
    found: list[list] = [[] for _ in docs]
    if numbers:
        starts = np.array(offsets)
        for s, n, p in runs(np.concatenate(numbers)):  # no run reaches over two texts: their numbers differ
            k = int(np.searchsorted(starts, s, "right")) - 1
            found[k].append((s - offsets[k], n, p))
    return [summary(i, words, f) for (i, words), f in zip(docs, found)]


def period_runs(docs: DataFrame, change=None, piece: int = PIECE) -> DataFrame:
    """Runs of every whole text of ``docs`` (doc_id, text); ``change``: (doc_id, words) -> words first."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()] * 2

    def out(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*summaries(held)), kinds)], names=names)

    def run(batches):
        held, size = [], 0
        for rb in batches:
            for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1)):
                words = (text.as_py() or "").encode().split()
                words = change(doc_id, words) if change else words
                if held and size + len(words) > piece:
                    yield out(held)
                    held, size = [], 0
                held.append((doc_id, words))
                size += len(words)
        if held:
            yield out(held)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


@register("op12_period_runs")
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs(base.table(spark, sf_dir, "documents"), planted)
