"""Toxicity by class-conditional Kneser-Ney bigram models.

Words are ASCII lower-cased runs outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.  Two
interpolated Kneser-Ney bigram models are counted, one on toxic and one on ordinary documents:
words count by the different words before them or, if fewer, documents, and bigrams by the
different words before them (so neither near copies nor a word repeated in one text weigh much);
a bigram backs off to its class's continuation counts (different words before a word), a word
to its class's counts of its stem (the first ``STEM`` bytes), and a stem to continuation counts
shared by both classes, so that an expression that neither or only one class has seen often
says little.  The discounts are high, as most bigrams of a sample are seen once.  A text is judged by the length-normalised difference of the
two log-likelihoods: over the whole text, over its most toxic runs of ``WINDOWS`` words, and over its
most toxic ``TOPS`` words.  A
logistic curve over these, fitted on scores of documents left out of the counts (two folds),
gives the probability.

Counts come from a bounded sample of labelled documents with different texts (``TOXIC`` and
``ORDINARY`` documents in expectation, by a hash of doc_id).  Null text counts as empty; a text
without words has differences of 0.  Several labels of one document: the greatest.  Without two
classes to learn from, every score is the share of class 1 (0 if there is no label).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldzones.llm import base
from fieldzones.llm.registry import register

TOXIC, ORDINARY, PAIR_DISCOUNT, FLOOR, STEM = 3000, 3000, 10.0, 0.5, 8
#: Discounts of word and stem counts, of which the best on left-out documents is taken.
DISCOUNTS = (1.0, 2.0, 3.0, 6.0, 10.0)
WINDOWS, TOPS, THRESHOLD, FOLDS = (4, 16, 64), (1, 3, 8), 0.3, 2
N_EVIDENCE = 1 + len(WINDOWS) + len(TOPS)
_START = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def tokens(data: np.ndarray, offs: np.ndarray):
    """Word hashes, the hash before each (a start mark for the first of a text), the hash of
    its stem, and the first words of the texts."""
    data = base.LOWER[data]
    s, e, first = base.word_bounds(data, offs, base.ALNUM_WORD)
    w = base.word_hashes(data, s, e)
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[first[:-1][first[:-1] < len(w)]] = _START
    return w, before, base.word_hashes(data, s, np.minimum(e, s + STEM)), first


def pair(before: np.ndarray, w: np.ndarray) -> np.ndarray:
    return base.mix(before * _PAIR + w)


def discounted(n: np.ndarray, lower: np.ndarray, discount: float) -> tuple[np.ndarray, float]:
    """Counts with the discount taken off, as shares, plus what that frees times ``lower``."""
    total = n.sum()
    rest = np.minimum(n, discount).sum() / total if total else 1.0
    return np.maximum(n - discount, 0) / max(total, 1) + rest * lower, rest


def find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, x)
    if not len(keys):
        return at, np.zeros(len(x), bool)
    at = np.minimum(at, len(keys) - 1)
    return at, keys[at] == x


def unique(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different rows of some columns."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return tuple(c[order[new]] for c in columns)


def counts(sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the sample (text, label, fold): the counts ``m`` of each (word, stem) and of each
    (before, word) in every label and fold, stored.  Rows of a batch are made different, and
    documents (whose texts differ) counted, before they are shuffled."""
    def seen(kind: str):
        def run(batches):
            for rb in batches:
                cell = rb.column(1).to_numpy(zero_copy_only=False).astype(np.int64) * FOLDS + rb.column(2).to_numpy(zero_copy_only=False)
                for a, to, data, offs in base.pieces(rb.column(0)):
                    w, before, stem, first = tokens(data, offs)
                    of = np.repeat(np.arange(a, to), np.diff(first))
                    if kind == "doc":  # the documents of each word: a sum of whole counts
                        word, stem, at = unique(w, stem, of.astype(np.uint64))
                        word, stem, at, n = totals(word, stem, cell[at.astype(np.int64)])
                        columns = [word, stem, at, n]
                    else:
                        if kind == "before":
                            word, over, other = w, before, stem
                        else:
                            earlier = np.empty_like(w)
                            earlier[1:] = before[:-1]
                            earlier[first[:-1][first[:-1] < len(w)]] = _START
                            word, over, other = w, earlier, before
                        word, other, over, at = unique(word, other, over, cell[of].astype(np.uint64))
                        columns = [word, other, at.astype(np.int64), base.signed(over)]
                    yield pa.RecordBatch.from_arrays([pa.array(base.signed(columns[0])), pa.array(base.signed(columns[1])), pa.array(columns[2].astype(np.int32)), pa.array(columns[3])], names=["word", "other", "cell", "x"])

        return sample.select("text", "y", "fold").mapInArrow(run, "word long, other long, cell int, x long")

    by = ["word", "other", "cell"]
    # dealt by the group, so that both steps take one shuffle
    different = lambda kind: seen(kind).repartition(*by).distinct().groupBy(by).agg(F.count("*").alias("m"))
    docs = seen("doc").groupBy(by).agg(F.sum("x").alias("docs"))
    words = different("before").join(docs, by).withColumn("m", F.least("m", "docs"))
    cell = [F.floor(F.col("cell") / FOLDS).cast("int").alias("label"), F.pmod("cell", F.lit(FOLDS)).alias("fold"), "m"]
    return (base.stored(words.select("word", F.col("other").alias("stem"), *cell)),
            base.stored(different("earlier").select(F.col("other").alias("before"), "word", *cell)))


def totals(word: np.ndarray, stem: np.ndarray, cell: np.ndarray):
    """Different rows and how often each is there."""
    order = np.lexsort((cell, stem, word))
    word, stem, cell = word[order], stem[order], cell[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (stem[1:] != stem[:-1]) | (cell[1:] != cell[:-1])
    at = np.flatnonzero(new)
    return word[at], stem[at], cell[at], np.diff(np.append(at, len(word)))


def tables(words: DataFrame, pairs: DataFrame):
    """Of each word its stem and its counts in either class and both; and of each pair above the
    discount its counts and those of its first word.  The other pairs' whole counts go to backing
    off, which needs no table."""
    n = lambda c: F.sum(F.when(F.col("label") == c, F.col("m")).otherwise(0))
    words = words.groupBy("word", "stem").agg(n(1).alias("cont_t"), n(0).alias("cont_o"), F.sum("m").alias("both"))
    # a pair above the discount has its share of it in some fold; bounded by the sample
    some = pairs.where(F.col("m") > PAIR_DISCOUNT / FOLDS).select("before").distinct()
    pairs = pairs.join(F.broadcast(some), "before").groupBy("before", "word").agg(n(1).alias("n_t"), n(0).alias("n_o"))
    cut = F.lit(PAIR_DISCOUNT)
    heads = pairs.groupBy("before").agg(*[x for c in "to" for x in (F.sum(f"n_{c}").alias(f"head_{c}"), F.sum(F.least(F.col(f"n_{c}"), cut)).alias(f"taken_{c}"))])
    high = pairs.where((F.col("n_t") > cut) | (F.col("n_o") > cut)).join(heads, "before")
    return words.toArrow(), high.toArrow()  # bounded by the sample


class Model:
    """Both classes' smoothed shares, from three tables of counts (see ``tables``)."""

    def __init__(self, words, pairs, discount: float):
        self.words = base.unsigned(words.column("word").to_numpy())
        order = np.argsort(self.words)
        self.words = self.words[order]
        stem = base.unsigned(words.column("stem").to_numpy())[order]
        self.stems, stem_of = np.unique(stem, return_inverse=True)
        shared = words.column("both").to_numpy()[order] + FLOOR
        by_stem = np.bincount(stem_of, shared, minlength=len(self.stems))
        whole = shared.sum() + FLOOR
        before, word = (base.unsigned(pairs.column(c).to_numpy()) for c in ("before", "word"))
        keys = pair(before, word)
        order2 = np.argsort(keys)
        self.keys = keys[order2]
        self.heads, head = np.unique(before, return_index=True)
        self.classes = []
        for c in ("t", "o"):
            own = words.column(f"cont_{c}").to_numpy()[order].astype(float)
            stems, free = discounted(np.bincount(stem_of, own, minlength=len(self.stems)), by_stem / whole, discount)
            shares, rest = discounted(own, stems[stem_of] * shared / by_stem[stem_of], discount)
            n_head = np.maximum(pairs.column(f"head_{c}").to_numpy().astype(float), 1)
            taken = pairs.column(f"taken_{c}").to_numpy().astype(float)
            above = np.maximum(pairs.column(f"n_{c}").to_numpy() - PAIR_DISCOUNT, 0) / n_head
            # the last three: a new word of a known stem (times a share that is the same for
            # both classes), a new stem (likewise), and what is left for backing off after a head
            self.classes.append((shares, above[order2], rest * stems, rest * free * FLOOR / whole, np.where(taken > 0, taken / n_head, 1.0)[head]))
        self.seen = np.zeros(1 << 22, bool)  # most pairs of a text are new: spares their search
        self.seen[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def differences(self, w: np.ndarray, before: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """Of each word: log probability as toxic less as ordinary text."""
        if not len(w) or not len(self.words):
            return np.zeros(len(w))
        (at, known), (h, headed), (s, stemmed) = find(self.words, w), find(self.heads, before), find(self.stems, stem)
        p = pair(before, w)
        some = np.flatnonzero(self.seen[(p >> np.uint64(42)).astype(np.int64)])
        k, hit = find(self.keys, p[some])
        logs = []
        for words, pairs, stems, new, back in self.classes:
            q = (np.where(headed, back[h], 1.0) if len(back) else 1.0) * np.where(known, words[at], np.where(stemmed, stems[s], new))
            q[some[hit]] += pairs[k[hit]]
            logs.append(np.log(q))
        return logs[0] - logs[1]


def evidence(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Of each text: the mean difference, the greatest mean over runs of WINDOWS words, and the mean
    of the greatest TOPS differences (as if 0 where there are fewer words)."""
    w, before, stem, first = tokens(data, offs)
    n = len(offs) - 1
    d = np.clip(model.differences(w, before, stem), -6, 6)
    total = np.concatenate([[0.0], np.cumsum(d)])
    out = np.zeros((n, N_EVIDENCE))
    size = np.diff(first)
    out[:, 0] = (total[first[1:]] - total[first[:-1]]) / np.maximum(size, 1)
    for j, k in enumerate(WINDOWS):
        m = len(d) - k + 1
        if m > 0:
            run = (total[k:] - total[:-k]) / k
            last = np.clip(first[1:] - k + 1, first[:-1], m)
            full = np.flatnonzero((size >= k))
            if len(full):
                bounds = np.column_stack([first[:-1][full], last[full]]).ravel()
                out[full, j + 1] = np.maximum.reduceat(np.append(run, -np.inf), bounds)[::2]
        few = (size < k) & (size > 0)  # a shorter text is one run
        out[few, j + 1] = (out[few, 0] * size[few]) / k
    of = np.repeat(np.arange(n), size)
    order = np.lexsort([-d, of])
    rank = np.arange(len(d)) - first[:-1][of]  # place among the text's words, greatest first
    for j, k in enumerate(TOPS):
        top = order[rank < k]
        out[:, 1 + len(WINDOWS) + j] = np.bincount(of[top], d[top], minlength=n) / k
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50):
    """Weights of a ridge logistic regression on standardised columns."""
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    a = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    b, pull = np.zeros(a.shape[1]), np.append(1e-6, np.full(x.shape[1], ridge * weight.sum() / 100))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - pull * b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, b


def curve(fitted, x: np.ndarray) -> np.ndarray:
    mean, spread, b = fitted
    return 1 / (1 + np.exp(-np.clip(b[0] + ((x - mean) / spread) @ b[1:], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str, toxic: int = TOXIC, ordinary: int = ORDINARY) -> dict:
    """A scorer from ``docs`` (doc_id, text) and ``labels`` (doc_id, ``label`` 0/1)."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # the label's values
    if not n.get(0) or not n.get(1):
        return {"share": 1.0 if n.get(1) else 0.0}
    share = F.when(F.col("y") == 1, float(toxic) / n[1]).otherwise(float(ordinary) / n[0])
    picked = known.where(F.col("y").isin(0, 1) & (base.hash_share(F.col("doc_id"), 11) < share))
    sample = docs.join(F.broadcast(picked), "doc_id").groupBy("text").agg(F.max("y").alias("y"), F.min("doc_id").alias("doc_id"))
    sample = base.stored(sample.select("text", "y", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold")))
    met = {r.y for r in sample.select("y").distinct().collect()}  # labels need not have documents here
    if met != {0, 1}:
        return {"share": 1.0 if 1 in met else 0.0}

    words, pairs = counts(sample)
    sc = docs.sparkSession.sparkContext
    others = [tables(words.where(F.col("fold") != f), pairs.where(F.col("fold") != f)) for f in range(FOLDS)]
    held = sc.broadcast(others)  # the counts: ten models would be many times their size on every disk
    del others

    def left_out(batches):
        of_discounts = [[Model(*counted, d) for counted in held.value] for d in DISCOUNTS]
        for rb in batches:
            fold = rb.column(2).to_numpy(zero_copy_only=False)
            for a, to, data, offs in base.pieces(rb.column(0)):
                own = fold[a:to], np.arange(to - a)
                x = np.concatenate([np.stack([evidence(m, data, offs) for m in models])[own] for models in of_discounts], axis=1)
                yield pa.RecordBatch.from_arrays([rb.column(1)[a:to], pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    seen = sample.mapInArrow(left_out, "y int, x array<double>").toPandas()  # bounded by the sample
    x, y = np.array(seen["x"].tolist()).reshape(-1, len(DISCOUNTS), N_EVIDENCE), seen["y"].to_numpy(float)
    order = np.lexsort([*x.reshape(len(x), -1).T, y])
    x, y = x[order], y[order]
    weight = np.where(y == 1, max(n[1] / toxic, 1.0), max(n[0] / ordinary, 1.0))  # the labels' own proportions
    held.destroy()

    def loss(fitted, x):
        p = np.clip(curve(fitted, x), 1e-6, 1 - 1e-6)
        return -(weight * np.log(np.where(y == 1, p, 1 - p))).sum()

    curves = [logistic(x[:, i], y, weight) for i in range(len(DISCOUNTS))]
    best = int(np.argmin([loss(c, x[:, i]) for i, c in enumerate(curves)]))
    # the model of all folds has so many times the counts: the discount grows with them
    return {"model": Model(*tables(words, pairs), DISCOUNTS[best] * FOLDS / (FOLDS - 1)), "curve": curves[best], "discount": DISCOUNTS[best]}


def score(docs: DataFrame, scorer: dict) -> DataFrame:
    """``docs`` with ``score`` in place of ``text``."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    carried = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches):
        s = sent.value
        for rb in batches:
            text = rb.column(rb.schema.get_field_index("text"))
            p = np.full(len(text), s.get("share", 0.0))
            if "model" in s:
                for a, to, data, offs in base.pieces(text):
                    p[a:to] = curve(s["curve"], evidence(s["model"], data, offs))
            yield pa.RecordBatch.from_arrays([rb.column(rb.schema.get_field_index(f.name)) for f in carried] + [pa.array(p)], names=[*[f.name for f in carried], "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in carried] + ["score double"])
    return docs.mapInArrow(run, schema)


@register("op7_kneser_ney")
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = base.id_remainder(F.col("doc_id"), 4) == 2
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = fit(docs, base.table(spark, sf_dir, "labels").where(~held_out), "toxic")
    return score(docs.withColumn("held_out", held_out), scorer).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
