"""Exact substring dedup: every byte in a string of ``length`` (100) bytes that also starts earlier.

1. Content-defined runs.  The key of a 100-byte window is the least hash of its ``GRAM``-byte
   grams; equal windows have equal keys.  Consecutive windows of one key are a run, about 1 for
   39 bytes, and its context is the bytes of its windows.  Runs of equal context are the same
   string: all but the earliest are removed whole, first inside an Arrow batch (so that a group
   of copies shrinks before the shuffle), then in a stream sorted by key.
2. Suffix arrays.  Keys that are left with several contexts (around edits and the ends of shared
   passages), or whose context repeats itself, are dealt to shards.  A shard concatenates its
   contexts, sorts all suffixes by Larsson-Sadakane refinement (ranks by 8 bytes, doubled for
   the groups still unsorted), takes common prefixes by Kasai's walk (many lanes at a time), and
   marks in every class of windows with 100 common bytes all but the earliest.
3. Merging.  A key with over ``SHARD`` contexts is split by document; its shards' surviving
   windows, sorted, are dealt by content and merged by binary search, earliest first.
4. The marked intervals of each document are joined, cut out, and the rest is hashed.

Keys and contexts are 64-bit hashes each, compared together; windows are compared by bytes.
Null text is empty.  Documents are ordered by doc_id, null last; rows of one doc_id are one
document for the order (by start) but each keeps its own text; a repeated row (same id and text)
does not remove its double and gets the same result.  Texts under 100 bytes lose nothing.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldzones.llm import base
from fieldzones.llm.registry import register

LENGTH, GRAM, LONGEST_RUN, SHARD = 100, 24, 400, 6000
_BLOCK, _CHUNK, _LANES = 1 << 19, 1 << 19, 4096
_LAST = (1 << 63) - 1
_P, _PINV = np.uint64(0x5851F42D4C957F2D), np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


@lru_cache(maxsize=2)
def powers(n: int, inverse: bool) -> np.ndarray:
    out = np.full(n, _PINV if inverse else _P, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


# a run's place: start << 32 | windows << 23 | 23 bits of the text's hash
def pack(start, windows, mark):
    return (start.astype(np.int64) << 32) | (windows.astype(np.int64) << 23) | mark.astype(np.int64)


def unpack(at):
    return at >> 32, (at >> 23) & 511, at & ((1 << 23) - 1)


def grams(b: np.ndarray, k: int = GRAM) -> np.ndarray:
    """A hash of every k bytes (k: a sum of two powers of two or one)."""
    h, width, parts = base.BYTE_KEYS[b], 1, {}
    while width <= k:
        parts[width] = h
        if width * 2 <= k:
            h = h[:-width] * base.WORD_KEYS[width.bit_length()] + h[width:]
            h ^= h >> np.uint64(31)
        width *= 2
    high = 1 << (k.bit_length() - 1)
    h = parts[high]
    if k > high:
        n = len(b) - k + 1
        h = h[:n] * base.WORD_KEYS[40] + parts[k - high][high:high + n]
    return base.mix(h)


def least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    m, width = h, 1
    while width * 2 <= w:
        m, width = np.minimum(m[:-width], m[width:]), width * 2
    return np.minimum(m[:len(m) - (w - width)], m[w - width:]) if w > width else m


def runs_of(b: np.ndarray, offs: np.ndarray, length: int = LENGTH):
    """Runs of windows in texts laid end to end: text, start in it, windows, key, hash of the
    context, and whether its grams repeat inside."""
    w, out = length - GRAM + 1, []
    begin, end = offs[:-1], offs[1:]
    for s in range(0, max(int(offs[-1]) - length + 1, 0), _BLOCK):
        x = b[s:s + _BLOCK + length - 1]
        h = grams(x)
        key = least(h, w)  # one for each window
        n = len(key)
        step = np.zeros(n + 1, np.int32)
        full = end - begin >= length
        np.add.at(step, np.clip(begin[full] - s, 0, n), 1)
        np.add.at(step, np.clip(end[full] - length + 1 - s, 0, n), -1)
        valid = np.cumsum(step[:-1]) > 0
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = (key[1:] != key[:-1]) | ~valid[:-1]
        at = begin[full] - s
        new[at[(at >= 0) & (at < n)]] = True
        new &= valid
        a = np.flatnonzero(new)
        if not len(a):
            continue
        stop = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]]))
        size = stop - a + 1
        parts = -(-size // LONGEST_RUN)
        if (parts > 1).any():
            a = np.repeat(a, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * LONGEST_RUN
            size = np.minimum(np.repeat(stop, parts) - a + 1, LONGEST_RUN)
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(base.BYTE_KEYS[x] * powers(_BLOCK + length, False)[:len(x)], out=total[1:])
        to = a + size + length - 1
        ctx = base.mix((total[to] - total[a]) * powers(_BLOCK + length, True)[a] + (to - a).astype(np.uint64))
        inside = np.arange(w)
        left = a + h[a[:, None] + inside].argmin(axis=1)
        z = a + size - 1
        right = z + w - 1 - h[z[:, None] + inside[::-1]].argmin(axis=1)
        text = np.searchsorted(offs, a + s, "right") - 1
        out.append((text, a + s - offs[text], size, key[a], ctx, (left != right) | (size > w)))
    if not out:
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool)]
    return [np.concatenate(c) for c in zip(*out)]


RUN_SCHEMA = "part long, dup boolean, own boolean, key long, ctx long, did long, at long"


def runs(docs: DataFrame) -> DataFrame:
    """All runs of (did, mark, text).  ``dup``: an earlier one of equal context is in the same
    batch.  ``part`` deals runs by key, and duplicates by document."""
    def run(batches):
        for rb in batches:
            did, mark = (rb.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            got = []
            for r, _, data, offs in base.pieces(rb.column(2)):
                text, start, size, key, ctx, own = runs_of(data, offs)
                got.append((key, ctx, did[r + text], pack(start, size, mark[r + text]), own))
            if not got:
                continue
            key, ctx, ids, at, own = (np.concatenate(c) for c in zip(*got))
            group = base.mix(key + ctx * np.uint64(0x9E3779B97F4A7C15))
            order = np.lexsort([at, ids, group])
            g, i, p = group[order], ids[order], at[order]
            new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0)) if len(g) else np.zeros(0, int)
            again = ~new & (i == i[first]) & (p == p[first])  # a repeated row
            order, dup = order[~again], ~new[~again]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.where(dup, base.signed(base.mix(ids[order].view(np.uint64))), base.signed(key[order]))), pa.array(dup), pa.array(own[order]),
                *[pa.array(base.signed(x[order])) for x in (key, ctx)], pa.array(ids[order]), pa.array(at[order])], names=["part", "dup", "own", "key", "ctx", "did", "at"])

    return docs.mapInArrow(run, RUN_SCHEMA)


def sort_out(rows: DataFrame) -> DataFrame:
    """(kind, key, did, at): 0 for runs to remove whole, 1 for the earliest run of each context of
    a key that has several, or repeats itself.  One sorted stream; it keeps one row in memory."""
    rows = rows.repartition("part").sortWithinPartitions("dup", "key", "ctx", "did", "at")

    def run(batches):
        held = None  # the first run of the last context; the first of the last key, if not given out
        for rb in batches:
            dup, own = (rb.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (1, 2))
            key, ctx, did, at = (rb.column(i).to_numpy() for i in (3, 4, 5, 6))
            yield from give(np.zeros(int(dup.sum()), np.int8), key[dup], did[dup], at[dup])
            key, ctx, did, at, own = (x[~dup] for x in (key, ctx, did, at, own))
            if not len(key):
                continue
            waiting = False
            if held is not None:
                key, ctx, did, at, own = (np.concatenate([[h], x]) for h, x in zip(held[:5], (key, ctx, did, at, own)))
                waiting = held[5]
            new_key = np.concatenate([[True], key[1:] != key[:-1]])
            new = new_key | np.concatenate([[True], ctx[1:] != ctx[:-1]])
            idx = np.arange(len(key))
            first = np.maximum.accumulate(np.where(new, idx, 0))
            gone = ~new & ~((did == did[first]) & (at == at[first]))
            heads = np.flatnonzero(new)
            several = np.zeros(len(key), bool)
            several[heads] = ~new_key[heads] | np.append(~new_key[heads[1:]], False) | own[heads].astype(bool)
            if held is not None and not waiting:
                several[0] = False  # given out before
            last = heads[-1]
            pending = not several[last] and not (held is not None and last == 0 and not waiting)
            yield from give(np.zeros(int(gone.sum()), np.int8), key[gone], did[gone], at[gone])
            yield from give(np.ones(int(several.sum()), np.int8), key[several], did[several], at[several])
            held = (key[last], ctx[last], did[last], at[last], own[last], pending)

    def give(kind, key, did, at):
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(key), pa.array(did), pa.array(at)], names=["kind", "key", "did", "at"])

    return rows.mapInArrow(run, "kind int, key long, did long, at long")


# -------------------------------------------------------------------------- suffix arrays

def suffix_array(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the 8 bytes at each place: Larsson-Sadakane refinement, which
    sorts only what is not yet told apart."""
    n = len(t)
    x = np.zeros(n + 8, np.uint64)
    x[:n] = t
    for width in (1, 2, 4):
        x[:-width] = (x[:-width] << np.uint64(8 * width)) | x[width:]
    x = x[:n]
    order = np.argsort(x, kind="stable")
    s = x[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0  # the end sorts before all places
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    h = 8
    while True:
        tied = ~new | np.append(~new[1:], False)  # places in groups of two or more
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        pos = order[slots]
        both = (rank[pos] << 32) | rank[np.minimum(pos + h, n)]
        by = np.argsort(both, kind="stable")
        pos, both = pos[by], both[by]
        order[slots] = pos
        apart = np.concatenate([[True], both[1:] != both[:-1]])
        new[slots] |= apart
        lead = np.maximum.accumulate(np.where(apart, slots, 0))
        rank[pos] = lead + 1
        h *= 2
    return order, x


def common_prefixes(order: np.ndarray, x: np.ndarray, need: int = LENGTH) -> np.ndarray:
    """Common bytes (``need`` at most) of each suffix with the one before it in the order, by
    Kasai's walk in text order, where a suffix has at most one byte less in common than the one
    before it.  The text is cut into lanes that walk side by side, 8 bytes a step."""
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    words = np.append(x, np.zeros(need + 8, np.uint64))
    out = np.zeros(n, np.int32)
    span = -(-n // _LANES) if n else 0
    lane = np.arange(0, n, max(span, 1))
    h = np.zeros(len(lane), np.int64)
    for step in range(span):
        i = lane + step
        live = i < n
        i = np.where(live, i, 0)
        j = before[i]
        live &= j >= 0
        h = np.where(live, np.maximum(h - 1, 0), 0)
        act = np.flatnonzero(live & (h < need))
        while len(act):
            diff = words[i[act] + h[act]] ^ words[j[act] + h[act]]
            same = diff == 0
            some = act[~same]
            if len(some):
                h[some] += 7 - (np.log2(diff[~same].astype(np.float64)).astype(np.int64) >> 3)
            act = act[same]
            h[act] += 8
            act = act[h[act] < need]
        room = n - np.maximum(i, j)
        h = np.minimum(np.minimum(h, need), room)
        good = lane + step < n
        out[(lane + step)[good]] = h[good]
    return out[order]


def later_windows(contexts: list[bytes], did: np.ndarray, at: np.ndarray, length: int = LENGTH):
    """For contexts laid end to end: their starts, and which window starts are not the earliest of
    their class."""
    size = np.array([len(c) for c in contexts], np.int64)
    t = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(size)])
    order, x = suffix_array(t)
    lcp = common_prefixes(order, x, length)
    of = np.repeat(np.arange(len(contexts)), size)
    inner = np.arange(len(t)) - begin[of]
    window = inner + length <= size[of]
    cls = np.cumsum(np.concatenate([[True], lcp[1:] < length])) - 1 if len(t) else np.zeros(0, int)
    keep = window[order]
    pos, cls = order[keep], cls[keep]
    start, _, mark = unpack(at)
    by = np.lexsort([mark[of[pos]], start[of[pos]] + inner[pos], did[of[pos]], cls])
    pos, cls = pos[by], cls[by]
    later = np.zeros(len(t), bool)
    later[pos[1:][cls[1:] == cls[:-1]]] = True
    return begin, later


def intervals(begin, later, did, at, length: int = LENGTH):
    """(did, mark, start, end) of the marked windows, joined where consecutive in a context."""
    pos = np.flatnonzero(later)
    if not len(pos):
        return [np.zeros(0, np.int64)] * 4
    of = np.searchsorted(begin, pos, "right") - 1
    new = np.concatenate([[True], (pos[1:] != pos[:-1] + 1) | (of[1:] != of[:-1])])
    last = np.concatenate([new[1:], [True]])
    start, _, mark = unpack(at)
    o = of[new]
    return [did[o], mark[o], start[o] + pos[new] - begin[o], start[o] + pos[last] - begin[o] + length]


SPAN_SCHEMA = "did long, mark long, start long, end long"


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, salt, did, at, context) of the wanted runs (key, salt, did, at)."""
    mark = F.col("at").bitwiseAND((1 << 23) - 1)
    lists = wanted.groupBy(F.col("did").alias("did_"), mark.alias("mark_")).agg(F.collect_list(F.struct("key", "salt", "at")).alias("w"))
    rows = docs.join(lists, (F.col("did") == F.col("did_")) & (F.col("mark") == F.col("mark_"))).select("did", "text", "w")

    def run(batches):
        for rb in batches:
            data, offs = base.text_bytes(rb.column(1))
            lists_ = rb.column(2)
            flat = lists_.flatten()
            at = flat.field(2).to_numpy()
            doc = np.repeat(np.arange(len(rb)), lists_.value_lengths().to_numpy())
            start, windows, _ = unpack(at)
            a = offs[doc] + start
            for i in range(0, len(at), 20_000):
                part = slice(i, i + 20_000)
                cut = [data[x:x + n + LENGTH - 1].tobytes() for x, n in zip(a[part], windows[part])]
                yield pa.RecordBatch.from_arrays([flat.field(0)[part], flat.field(1)[part], pa.array(rb.column(0).to_numpy()[doc[part]]), pa.array(at[part]), pa.array(cut, pa.binary())], names=["key", "salt", "did", "at", "context"])

    return rows.mapInArrow(run, "key long, salt int, did long, at long, context binary")


def by_shard(rows: DataFrame, split: bool) -> DataFrame:
    """Intervals to remove, of shards of whole keys; for ``split`` keys the surviving windows of
    each shard instead come along with ``window`` (and no interval is lost)."""
    rows = rows.repartition("key", "salt").sortWithinPartitions("key", "salt")

    def work(held):
        key, salt, did, at = (np.concatenate([h[c] for h in held]) for c in range(4))
        ctx = [c for h in held for c in h[4]]
        once = np.unique(np.rec.fromarrays([key, did, at]), return_index=True)[1]  # repeated rows
        key, did, at, ctx = key[once], did[once], at[once], [ctx[i] for i in once]
        begin, later = later_windows(ctx, did, at)
        out = intervals(begin, later, did, at)
        none = pa.nulls(len(out[0]), pa.binary())
        yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in out], pa.nulls(len(out[0]), pa.int64()), none], names=["did", "mark", "start", "end", "key", "window"])
        if split:
            t = b"".join(ctx)
            size = np.diff(begin)
            of = np.repeat(np.arange(len(ctx)), size)
            inner = np.arange(len(t)) - begin[of]
            pos = np.flatnonzero(~later & (inner + LENGTH <= size[of]))
            start, _, mark = unpack(at)
            for i in range(0, len(pos), 20_000):
                p = pos[i:i + 20_000]
                s = start[of[p]] + inner[p]
                yield pa.RecordBatch.from_arrays([pa.array(did[of[p]]), pa.array(mark[of[p]]), pa.array(s), pa.array(s + LENGTH), pa.array(key[of[p]]), pa.array([t[x:x + LENGTH] for x in p], pa.binary())], names=["did", "mark", "start", "end", "key", "window"])

    def run(batches):
        held, size, last = [], 0, None
        for rb in batches:
            key, salt = rb.column(0).to_numpy(), rb.column(1).to_numpy()
            cols = [key, salt, rb.column(2).to_numpy(), rb.column(3).to_numpy(), rb.column(4).to_pylist()]
            cuts = np.flatnonzero(np.concatenate([[last is not None and (key[0], salt[0]) != last], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])) if len(key) else []
            a = 0
            for b in [*cuts, len(key)]:  # a shard takes whole keys until it is large enough
                if b in cuts and size + sum(map(len, cols[4][a:b])) < _CHUNK:
                    continue
                if b > a:
                    held.append([c[a:b] for c in cols])
                    size += sum(map(len, cols[4][a:b]))
                a = b
                if b in cuts and held:
                    yield from work(held)
                    held, size = [], 0
            if len(key):
                last = (key[-1], salt[-1])
        if held:
            yield from work(held)

    return rows.mapInArrow(run, f"{SPAN_SCHEMA}, key long, window binary")


def merge(rows: DataFrame, parts: int) -> DataFrame:
    """Of the surviving windows of split keys: those that another shard has earlier."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["did", "start", "mark"], kind="stable")
        w = pdf["window"].to_numpy()
        held = np.zeros(0, f"S{LENGTH + 1}")
        out = np.zeros(len(w), bool)
        for i in range(0, len(w), 50_000):  # earlier blocks are sorted: later ones look them up
            own = np.array([x + b"." for x in w[i:i + 50_000]], f"S{LENGTH + 1}")  # NULs at the end count
            at = np.minimum(np.searchsorted(held, own), max(len(held) - 1, 0))
            known = held[at] == own if len(held) else np.zeros(len(own), bool)
            _, first = np.unique(own, return_index=True)
            again = np.ones(len(own), bool)
            again[first] = False
            out[i:i + 50_000] = known | again
            held = np.sort(np.concatenate([held, own[first][~known[first]]]))
        return pdf.loc[out, ["did", "mark", "start", "end"]]

    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("window"), F.lit(parts)))
    return dealt.groupBy("key", "deal").applyInPandas(run, SPAN_SCHEMA)


# --------------------------------------------------------------------------------- results

def order_id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))


def text_mark():
    return F.xxhash64("text").bitwiseAND((1 << 23) - 1)


def removals(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(did, mark, spans) with the intervals to remove of each document that has any."""
    texts = docs.select(order_id().alias("did"), text_mark().alias("mark"), "text").where(F.octet_length("text") >= LENGTH)
    found = base.stored(sort_out(runs(texts)))
    whole = found.where("kind = 0").select("did", F.col("at").bitwiseAND((1 << 23) - 1).alias("mark"), F.shiftright("at", 32).alias("start"),
                                           (F.shiftright("at", 32) + F.shiftright("at", 23).bitwiseAND(511) + (LENGTH - 1)).alias("end"))
    several = found.where("kind = 1").select("key", "did", "at")
    crowded = base.stored(several.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > shard)).withColumnRenamed("key", "key_")
    salt = F.coalesce(F.pmod(F.xxhash64("did"), F.ceil(F.col("n") / shard)), F.lit(0)).cast("int")
    wanted = several.join(crowded, F.col("key") == F.col("key_"), "left").select("key", salt.alias("salt"), "did", "at", F.col("n").isNotNull().alias("split"))
    cut = contexts(texts, wanted.where("NOT split"))
    spans = whole.unionByName(by_shard(cut, False).select("did", "mark", "start", "end"))
    most = crowded.agg(F.max("n")).first()[0]
    if most:
        pieces = base.stored(by_shard(contexts(texts, wanted.where("split")), True))
        spans = spans.unionByName(pieces.where("window IS NULL").select("did", "mark", "start", "end"))
        spans = spans.unionByName(merge(pieces.where("window IS NOT NULL"), -(-int(most) // shard)))
    return base.stored(spans.groupBy("did", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans")))


def joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.concatenate([new[1:], [True]])]


def cut_out(docs: DataFrame, found: DataFrame, schema: str, make) -> DataFrame:
    """``make(batch, texts, spans)`` over documents and their spans: for each text its bytes, and
    the starts and ends of its maximal removed runs."""
    found = found.select(F.col("did").alias("_llm_did"), F.col("mark").alias("_llm_mark"), F.col("spans").alias("_llm_spans"))
    rows = docs.withColumn("_llm_own_did", order_id()).withColumn("_llm_own_mark", text_mark())
    rows = rows.join(found, (F.col("_llm_own_did") == F.col("_llm_did")) & (F.col("_llm_own_mark") == F.col("_llm_mark")), "left").select(*docs.columns, "_llm_spans")

    def run(batches):
        for rb in batches:
            data, offs = base.text_bytes(rb.column(rb.schema.get_field_index("text")))
            lists = rb.column(rb.schema.get_field_index("_llm_spans"))
            flat = lists.flatten()
            s, e = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
            n = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            cuts = [joined(s[n[i]:n[i + 1]], e[n[i]:n[i + 1]]) if n[i + 1] > n[i] else (s[:0], e[:0]) for i in range(len(rb))]
            yield make(rb, [data[offs[i]:offs[i + 1]] for i in range(len(rb))], cuts)

    return rows.mapInArrow(run, schema)


def rest(text: np.ndarray, cut) -> bytes:
    edges = [0, *(x for ab in zip(*cut) for x in ab), len(text)]
    return b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2]))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without their removed bytes.  A character that loses a byte
    goes whole; n_chars follows the text; a null text stays null, an emptied one is empty."""
    base.prepare(spark)

    def make(rb, texts, cuts):
        text = rb.column(rb.schema.get_field_index("text"))
        new = [old if not len(c[0]) else rest(t, c).decode("utf-8", "ignore") for old, t, c in zip(text.to_pylist(), texts, cuts)]
        changed = np.array([len(c[0]) > 0 for c in cuts], bool)
        out = []
        for f in rb.schema:
            c = rb.column(rb.schema.get_field_index(f.name))
            if f.name == "text":
                c = pa.array(new, f.type)
            elif f.name == "n_chars":
                c = pa.array([len(t) if ch else o for t, ch, o in zip(new, changed, c.to_pylist())], f.type)
            if f.name != "_llm_spans":
                out.append((f.name, c))
        return pa.RecordBatch.from_arrays([c for _, c in out], names=[n for n, _ in out])

    return cut_out(docs, removals(docs), docs.schema, make)


@register("op1_suffix_array")
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(rb, texts, cuts):
        left = [rest(t, c) for t, c in zip(texts, cuts)]
        size = np.array([len(t) for t in texts], np.int64)
        return pa.RecordBatch.from_arrays([
            rb.column(0), pa.array(size), pa.array(size - np.array([len(x) for x in left], np.int64)), pa.array(np.array([len(c[0]) for c in cuts], np.int64)),
            pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return cut_out(docs, removals(docs), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", make)
