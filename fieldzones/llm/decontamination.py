"""Benchmark decontamination by winnowing.

Words are ASCII lower-cased runs outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.  Every run of
``k`` words is hashed, and of every ``w`` consecutive hashes the least (the rightmost of equal
ones) is kept as a fingerprint.  A span of ``w + k - 1`` words (13) that a document shares with
a benchmark item contains a whole window, whose least hash both sides keep, so joining the
fingerprints finds it; each hit is then extended word by word to its full length, and runs of
at least 13 words are marked.  Items of fewer words are one window of their own length: for
these lengths (12 at most, only those that occur) every run is fingerprinted.

The benchmark goes to the tasks in blocks of at most ``block_words`` words each, and each block
meets all documents; with one block (any benchmark of up to two million words) there is no
shuffle at all.  Spans of several blocks are put together per document.

Null or empty text: no words, never contaminated.  Items without words occur nowhere.  Equal
items all count; rows of one item_id count once.  Repeated document rows give repeated results.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldzones.llm import base
from fieldzones.llm.registry import register

SPAN, GRAM = 13, 5
BLOCK_WORDS = 2_000_000


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least of every ``w`` consecutive hashes, the rightmost of equal ones."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, back = grams[w - 1:].copy(), np.zeros(n, np.uint8)
    for j in range(1, w):
        g = grams[w - 1 - j:w - 1 - j + n]
        back[g < least] = j
        np.minimum(least, g, out=least)
    return np.unique(np.arange(w - 1, len(grams)) - back)


class Block:
    """Fingerprints of some benchmark items, sorted for lookup."""

    def __init__(self, ids: list, texts: list, span: int = SPAN, gram: int = GRAM):
        data, offs = base.text_bytes(pa.array(texts, pa.string()))
        data = base.LOWER[data]
        starts, ends, first = base.word_bounds(data, offs, base.ALNUM_WORD)
        self.ids, self.first, self.span, self.gram = list(ids), first, span, gram
        self.words = base.word_hashes(data, starts, ends)
        sizes = np.diff(first)
        self.owner = np.repeat(np.arange(len(ids)), sizes)
        # Windows over the end of a text add fingerprints, which extension drops.
        grams = base.window_hashes(self.words, gram)
        at = winnow(grams, span - gram + 1)
        at = at[sizes[self.owner[at]] >= span]
        order = np.argsort(grams[at], kind="stable")
        self.at = at[order]
        self.keys = grams[self.at]
        self.short = {}
        for m in sorted({int(x) for x in sizes if 0 < x < span}):
            own = np.flatnonzero(sizes == m)
            h = np.array([base.window_hashes(self.words[first[i]:first[i + 1]], m)[0] for i in own], np.uint64)
            o = np.argsort(h, kind="stable")
            self.short[m] = (h[o], own[o])

    def marks(self, words: np.ndarray, first: np.ndarray):
        """Marked [from, to) runs of words and the items that occur, as (text, from, to, item)."""
        out, seen = [], {}
        grams = base.window_hashes(words, self.gram)
        at = winnow(grams, self.span - self.gram + 1)
        if len(self.keys) and len(at):
            lo = np.searchsorted(self.keys, grams[at], "left")
            for k in np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == grams[at]):
                p, j = int(at[k]), int(lo[k])
                d = int(np.searchsorted(first, p, "right")) - 1
                while j < len(self.keys) and self.keys[j] == grams[p]:
                    q = int(self.at[j])
                    i, j = int(self.owner[q]), j + 1
                    if p < seen.get((d, i, p - q), 0):
                        continue  # inside the last run found on this diagonal
                    b, e = self.reach(words, p, int(first[d]), int(first[d + 1]), q, int(self.first[i]), int(self.first[i + 1]))
                    seen[d, i, p - q] = e
                    if e - b >= self.span:
                        out.append((d, b, e, i))
        for m, (keys, own) in self.short.items():
            h = base.window_hashes(words, m)
            lo = np.searchsorted(keys, h, "left")
            for p in np.flatnonzero((lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == h)):
                d = int(np.searchsorted(first, p, "right")) - 1
                if p + m <= first[d + 1]:
                    j = int(lo[p])
                    while j < len(keys) and keys[j] == h[p]:
                        out.append((d, int(p), int(p) + m, int(own[j])))
                        j += 1
        return out

    def reach(self, words, p, p0, p1, q, q0, q1):
        """The whole common run around word p of the text and word q of the item."""
        back = min(p - p0, q - q0)
        a, b = words[p - back:p], self.words[q - back:q]
        differ = np.flatnonzero(a != b)
        begin = p - back + (int(differ[-1]) + 1 if len(differ) else 0)
        ahead = min(p1 - p, q1 - q)
        differ = np.flatnonzero(words[p:p + ahead] != self.words[q:q + ahead])
        return begin, p + (int(differ[0]) if len(differ) else ahead)


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> list[DataFrame]:
    """The items in parts of about ``block_words`` words, by a hash of the item."""
    items = benchmark.select("item_id", "text")
    words = items.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)))).first()[0] or 0
    n = max(1, -(-int(words) // (3 * block_words)))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.where(part == i) for i in range(n)]


def find_spans(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(row columns..., n_words, spans, items) of each document row and block: word spans
    [start, end) that lie in occurrences of windows, not merged, and the items they are from."""
    carried = [c for c in docs.columns if c != "text"]
    kinds = docs.select(*carried).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + ["n_words long", "starts array<long>", "ends array<long>", "items array<string>"])

    def one(part: DataFrame) -> DataFrame:
        rows = part.collect()  # bounded: one block of the benchmark
        sc = docs.sparkSession.sparkContext
        sent = sc.broadcast(Block([r.item_id for r in rows], [r.text for r in rows]))

        def search(batches):
            block = sent.value
            for rb in batches:
                text = rb.column(rb.schema.get_field_index("text"))
                n_words = np.zeros(len(text), np.int64)
                marks = [([], [], set()) for _ in range(len(text))]
                for a, _, data, offs in base.pieces(text):
                    data = base.LOWER[data]
                    s, e, first = base.word_bounds(data, offs, base.ALNUM_WORD)
                    n_words[a:a + len(first) - 1] = np.diff(first)
                    for d, b, t, i in block.marks(base.word_hashes(data, s, e), first):
                        m = marks[a + d]
                        m[0].append(b - int(first[d]))
                        m[1].append(t - int(first[d]))
                        if block.ids[i] is not None:
                            m[2].add(str(block.ids[i]))
                yield pa.RecordBatch.from_arrays(
                    [rb.column(rb.schema.get_field_index(c)) for c in carried]
                    + [pa.array(n_words), pa.array([m[0] for m in marks], pa.list_(pa.int64())), pa.array([m[1] for m in marks], pa.list_(pa.int64())), pa.array([sorted(m[2]) for m in marks], pa.list_(pa.string()))],
                    names=[*carried, "n_words", "starts", "ends", "items"])

        return docs.select(*carried, "text").mapInArrow(search, schema)

    return reduce(DataFrame.unionByName, [one(p) for p in blocks(benchmark, block_words)])


def covered(starts: str, ends: str):
    """Words inside the union of the spans (both arrays in step)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(F.sort_array(F.arrays_zip(starts, ends)), zero, lambda acc, p: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), p[ends] - F.greatest(p[starts], acc["to"]))).alias("n"),
        F.greatest(acc["to"], p[ends]).alias("to")), lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document row."""
    n = len(blocks(benchmark, block_words))
    found = find_spans(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), benchmark, block_words)
    if n > 1:  # the results of all blocks for equal rows, then as many rows as there were
        found = found.groupBy("doc_id", "text_hash", "n_words").agg(
            *[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")], (F.count("*") / n).cast("int").alias("times"))
        found = found.select("doc_id", "n_words", "starts", "ends", "items", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id", "n_words", covered("starts", "ends").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are not contaminated, with all their columns."""
    return clean(docs, base.table(spark, sf_dir, "benchmark"))


def clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged.  One pass over the texts for
    each block of the benchmark; the words a row has to have hit are counted over all blocks."""
    sc = docs.sparkSession.sparkContext
    sent = [sc.broadcast(Block([r.item_id for r in rows], [r.text for r in rows])) for rows in (p.collect() for p in blocks(benchmark, block_words))]

    def keep(batches):
        for rb in batches:
            text = rb.column(rb.schema.get_field_index("text"))
            good = np.ones(len(text), bool)
            for a, _, data, offs in base.pieces(text):
                data = base.LOWER[data]
                s, e, first = base.word_bounds(data, offs, base.ALNUM_WORD)
                words = base.word_hashes(data, s, e)
                step = np.zeros(len(words) + 1, np.int64)
                for x in sent:
                    for _, b, t, _ in x.value.marks(words, first):
                        step[b] += 1
                        step[t] -= 1
                hit = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
                n_hit = hit[first[1:]] - hit[first[:-1]]
                good[a:a + len(n_hit)] = ~((n_hit > 0) & (20 * n_hit >= np.diff(first)))
            yield rb.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i2 AS (SELECT item_id, w, least(13, len(w)) AS m FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS win
       FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM i2)),
dw AS (SELECT r, p, m, array_to_string(w[p:p + m - 1], ' ') AS win
       FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p
             FROM d, (SELECT DISTINCT m FROM i2) WHERE len(w) >= m)),
hit AS (SELECT dw.r, dw.p, dw.m, iw.item_id FROM dw JOIN iw USING (win, m)),
words AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + m)) AS q FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON d.r = words.r LEFT JOIN items ON d.r = items.r
"""


@register("op8_winnowing", ORACLE)
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))
