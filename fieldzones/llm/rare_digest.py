"""Improbable-feature digests of documents.

A feature is a window of ``WINDOW`` bytes.  Its entropy is put into ``LEVELS`` levels; counted over all
documents these give each level's rarity, and the rarest levels come first.  Within each ``SPREAD``
consecutive windows the leftmost of the rarest gets a point, and a window of ``POPULAR`` points or more
is improbable enough for the digest.  Windows below ``LEAST`` (nearly constant bytes) are never
chosen; a text without a chosen window, as one shorter than a window, is one feature as a whole.
The different features go, in text order, into Bloom filters of 2,048 bits (five bits a feature);
after 160 the next filter of the chain begins.

A digest is ``<filters>:<hex>``.  Two digests are compared filter by filter: each filter of the shorter
chain with the best of the other's, bits in common against what chance gives, cut below 30 % of
the possible range and averaged by bits set.  1: equal digests, 0: no more than chance.

Texts are dealt by ranges of doc_id, so that each document stands before the next one (doc_id
descending) in its task; only a task's first and last document are joined across tasks.

The entropies are sums of integers, so equal texts have equal digests in any batch.  Null text: empty.
Empty text: no filter; it is like another empty one (1) and unlike all others (0).  Null doc_ids
come after all others.  Rows of one doc_id are ordered by text hash (ties are equal texts), repeated
rows being documents of their own; the last document is followed by the first, a single one by
itself.  A text and the next one have to fit into one task; columns other than doc_id and text are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldzones.llm import base
from fieldzones.llm.registry import register

WINDOW, SPREAD, POPULAR = 64, 64, 16
LEVELS, LEAST = 1001, 100
BITS, HASHES, FULL = 2048, 5, 160
CUT = 0.3
#: Bytes that are looked at together, and steps of a lane that slides over them.
PIECE, STEPS = 1 << 20, 448

#: c * log2(c) as integers
_C = np.arange(WINDOW + 1)
_TERM = np.round(_C * np.log2(np.maximum(_C, 1)) * (1 << 16)).astype(np.int32)
_MOST = int(_TERM[WINDOW])
_POPCOUNT = np.array([x.bit_count() for x in range(256)], np.uint8)


def levels(data: np.ndarray) -> np.ndarray:
    """Entropy level (0: one byte only, 1000: all different) of the window that starts at each place.

    The windows slide in lanes, all lanes by one byte a step: a byte goes, one comes, and the
    sum of c * log2(c) over the counts changes by two terms."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    lanes = -(-n // STEPS)
    padded = np.zeros(lanes * STEPS + WINDOW, np.uint8)
    padded[:len(data)] = data
    by_step = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (lanes, STEPS + WINDOW), (STEPS, 1)).T).astype(np.int32)
    by_step += np.arange(lanes, dtype=np.int32) * 256
    counts = np.zeros(lanes * 256, np.int8)
    total = np.zeros(lanes, np.int32)
    up = np.append(np.diff(_TERM), 0).astype(np.int32)

    def come(at):
        c = counts[at]
        np.add(total, up[c], out=total)
        counts[at] = c + 1

    for t in range(WINDOW):
        come(by_step[t])
    out = np.empty((STEPS, lanes), np.int16)
    scale = (LEVELS - 1) / _MOST
    for t in range(STEPS):
        out[t] = ((_MOST - total) * scale).astype(np.int16)
        at = by_step[t]
        c = counts[at] - 1
        np.subtract(total, up[c], out=total)
        counts[at] = c
        come(by_step[t + WINDOW])
    return out.T.reshape(-1)[:n]


def sliding_least(key: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` consecutive keys."""
    size, least = 1, key
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[:len(key) - w + 1], least[w - size:w - size + len(key) - w + 1])
    return least


def chosen(rank: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of the chosen windows.  ``rank`` of the windows of several texts (negative: never), one
    after the other, each followed by SPREAD - 1 places of rank -1; ``first``: is a text's first place."""
    if not len(rank):
        return np.zeros(0, np.int64)
    worst = np.int64(1) << 60
    key = np.where(rank >= 0, (rank.astype(np.int64) << 40) | np.arange(len(rank)), worst)
    key = np.concatenate([np.full(SPREAD - 1, worst), key])  # before the first text, as behind each
    least = sliding_least(key, SPREAD)
    points = np.bincount(least[least < worst] & ((1 << 40) - 1), minlength=len(rank))
    return np.flatnonzero(points >= POPULAR)


def feature_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for j in range(WINDOW):
        h += base.BYTE_KEYS[data[at + j]] * base.WORD_KEYS[j]
    return base.mix(h)


class Digest:
    """Bloom filters (rows of 256 bytes) of one text."""

    __slots__ = ("filters", "set")

    def __init__(self, filters: np.ndarray):
        self.filters = filters
        self.set = _POPCOUNT[filters].sum(axis=1, dtype=np.int64)

    def __str__(self):
        return f"{len(self.filters)}:{self.filters.tobytes().hex()}"

    @staticmethod
    def parse(text: str) -> "Digest":
        n, _, bits = text.partition(":")
        return Digest(np.frombuffer(bytes.fromhex(bits), np.uint8).reshape(int(n), BITS // 8))


def chain(hashes: np.ndarray) -> Digest:
    """Filters of a text's features, in text order, each feature once."""
    if len(hashes):
        _, at = np.unique(hashes, return_index=True)
        hashes = hashes[np.sort(at)]
    filters = np.zeros((-(-len(hashes) // FULL), BITS), bool)
    row = np.arange(len(hashes)) // FULL
    for k in range(HASHES):
        filters[row, ((hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return Digest(np.packbits(filters, axis=1))


def likeness(a: Digest, b: Digest, block: int = 512) -> float:
    """Normalised overlap of two digests, 0 to 1."""
    if not len(a.filters) or not len(b.filters):
        return float(len(a.filters) == len(b.filters))
    if (len(a.filters), int(a.set.sum())) > (len(b.filters), int(b.set.sum())):
        a, b = b, a
    best = np.zeros(len(a.filters))
    for s in range(0, len(a.filters), block):
        x = np.unpackbits(a.filters[s:s + block], axis=1).astype(np.float32)
        ex = a.set[s:s + block, None].astype(float)
        for t in range(0, len(b.filters), block):
            common = (x @ np.unpackbits(b.filters[t:t + block], axis=1).astype(np.float32).T).astype(float)
            ey = b.set[None, t:t + block].astype(float)
            most, chance = np.minimum(ex, ey), ex * ey / BITS
            cut = chance + CUT * (most - chance)
            best[s:s + block] = np.maximum(best[s:s + block], np.clip((common - cut) / (most - cut), 0, 1).max(axis=1))
    return float((best * a.set).sum() / a.set.sum())


def whole_feature(raw: bytes) -> np.ndarray:
    return np.frombuffer(hashlib.sha256(raw).digest()[:8], np.uint64) if raw else np.zeros(0, np.uint64)


def digests(texts: list[bytes], known: list[np.ndarray], rank: np.ndarray) -> list[Digest]:
    """Digest of each text, given the levels of its windows."""
    out, a = [], 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= PIECE):
            size += len(texts[b])
            b += 1
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        n = np.array([len(x) for x in known[a:b]])
        starts = np.cumsum([0, *(n + SPREAD - 1)])[:-1]
        offs = np.cumsum([0, *map(len, texts[a:b])])
        flat = np.full(int((n + SPREAD - 1).sum()), -1, np.int64)
        for s, x in zip(starts, known[a:b]):
            flat[s:s + len(x)] = rank[x]
        at = chosen(flat, starts)
        of = np.searchsorted(starts, at, "right") - 1
        h = feature_hashes(data, at - starts[of] + offs[of])
        cuts = np.searchsorted(of, np.arange(b - a + 1))
        for k in range(b - a):
            own = h[cuts[k]:cuts[k + 1]]
            out.append(chain(own if len(own) else whole_feature(texts[a + k])))
        a = b
    return out


def levels_of(texts: list[bytes]) -> list[np.ndarray]:
    """Levels of each text's windows; texts are taken together, windows over an end dropped."""
    out, a = [], 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= PIECE):
            size += len(texts[b])
            b += 1
        found = levels(np.frombuffer(b"".join(texts[a:b]), np.uint8))
        at = 0
        for x in texts[a:b]:
            out.append(found[at:at + max(len(x) - WINDOW + 1, 0)])
            at += len(x)
        a = b
    return out


def place_of(raw: bytes, n: int) -> int:
    """Byte at which code point ``n`` begins."""
    if raw.isascii():
        return min(n, len(raw))
    begins = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return int(begins[n]) if n < len(begins) else len(raw)


def edited(raw: bytes, n_chars: int, after: bytes) -> tuple[int, int]:
    """Bytes that stay of ``raw`` and bytes of ``after`` that replace the rest: a third of the code points."""
    return place_of(raw, n_chars - n_chars // 3), place_of(after, n_chars // 3)


def joined_levels(text: bytes, own, keep, seam, other, take):
    """Levels of ``text`` = raw[:keep] + after[:take] from those of raw, of the seam and of after."""
    n = max(len(text) - WINDOW + 1, 0)
    left, right = max(keep - WINDOW + 1, 0), max(take - WINDOW + 1, 0)
    return np.concatenate([own[:left], seam[:n - left - right], other[:right]])


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each level by its number of windows in all texts, the rarest first; -1 below LEAST."""
    def run(batches):
        total = np.zeros(LEVELS, np.int64)
        for rb in batches:
            for _, _, data, offs in base.pieces(rb.column(0), PIECE):
                found = levels(data)
                ok = np.ones(len(found) + 1, np.int32)
                for e in offs[1:-1]:  # windows over the end of a text
                    ok[max(e - WINDOW + 1, 0):min(e, len(found))] = 0
                total += np.bincount(found[ok[:-1] > 0], minlength=LEVELS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["level", "n"])

    n = np.zeros(LEVELS, np.int64)
    for r in docs.select("text").mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():  # LEVELS rows at most
        n[r.level] = r.n
    rank = np.empty(LEVELS, np.int64)
    rank[np.lexsort((np.arange(LEVELS), n))] = np.arange(LEVELS)
    rank[:LEAST] = -1
    return rank


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
_NAMES = [x.split()[0] for x in RESULT.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def chars(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw.decode())


def compared(docs: list[tuple], rank: np.ndarray) -> list[tuple]:
    """Result rows of all but the last of (doc_id, bytes) documents, each with the one after it."""
    texts = [raw for _, raw in docs]
    known = levels_of(texts)
    own = digests(texts, known, rank)
    cuts = [edited(texts[k], chars(texts[k]), texts[k + 1]) for k in range(len(docs) - 1)]
    new = [texts[k][:keep] + texts[k + 1][:take] for k, (keep, take) in enumerate(cuts)]
    # only windows over the seam are new
    seams = levels_of([x[max(keep - WINDOW + 1, 0):keep + WINDOW - 1] for x, (keep, _) in zip(new, cuts)])
    new_levels = [joined_levels(x, known[k], keep, seams[k], known[k + 1], take) for k, (x, (keep, take)) in enumerate(zip(new, cuts))]
    other = digests(new, new_levels, rank)
    return [(docs[k][0], chars(texts[k]), hashlib.sha256(new[k]).hexdigest(), str(own[k]), str(other[k]),
             likeness(own[k], other[k]), likeness(own[k], own[k + 1])) for k in range(len(docs) - 1)]


def rows_to_batch(rows: list[tuple], extra=()) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS)] + [pa.array([v] * len(rows), t) for _, v, t in extra], names=[*_NAMES, *[n for n, _, _ in extra]])


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of ``RESULT`` for ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranks = spark.sparkContext.broadcast(rarity(docs))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("doc_id").desc_nulls_last(), F.col("order_").desc(), F.col("text").desc()]
    dealt = docs.withColumn("order_", F.xxhash64("text")).repartitionByRange(n, *by[:2]).sortWithinPartitions(*by).select("doc_id", "text")

    def run(batches):
        """Results, and a task's first and last text, which have their neighbours in other tasks."""
        task, held, size, begun = TaskContext.get().partitionId(), [], 0, False

        def ends(kind, doc):
            return rows_to_batch([(doc[0], None, None, doc[1].decode(), None, None, None)], [("kind", kind, pa.int32()), ("task", task, pa.int32())])

        for rb in batches:
            for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1)):
                raw = text.as_py().encode()
                if not begun:
                    begun = True
                    yield ends(1, (doc_id, raw))
                held.append((doc_id, raw))
                size += len(raw)
                if size > 2 * PIECE and len(held) > 1:
                    yield rows_to_batch(compared(held, ranks.value), [("kind", 0, pa.int32()), ("task", task, pa.int32())])
                    held, size = held[-1:], len(held[-1][1])
        if held:
            if len(held) > 1:
                yield rows_to_batch(compared(held, ranks.value), [("kind", 0, pa.int32()), ("task", task, pa.int32())])
            yield ends(2, held[-1])

    found = base.stored(dealt.mapInArrow(run, RESULT + ", kind int, task int"))
    # tasks with documents in order (no texts here), each with the next one
    tasks = found.where("kind = 1").select("task").withColumn("next", F.lead("task").over(Window.orderBy("task")))
    firsts = found.where("kind = 1").select(F.col("task").alias("next"), F.col("fingerprint").alias("after"))
    start = found.where("kind = 1").agg(F.min("task").alias("least"))
    lasts = found.where("kind = 2").select("task", "doc_id", F.col("fingerprint").alias("text")).join(tasks, "task")
    lasts = lasts.withColumn("next", F.coalesce("next", F.lit(start.first()[0]))).join(firsts, "next").select("doc_id", "text", "after")

    def finish(batches):
        for rb in batches:
            for doc_id, text, after in zip(*(rb.column(k).to_pylist() for k in range(3))):
                yield rows_to_batch(compared([(doc_id, text.encode()), (None, after.encode())], ranks.value))

    return found.where("kind = 0").select(*_NAMES).unionByName(lasts.mapInArrow(finish, RESULT))


@register("op11_rare_features")
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(base.table(spark, sf_dir, "documents"))
