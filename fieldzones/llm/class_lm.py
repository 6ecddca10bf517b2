"""Language-model scores by a Brown class-based bigram model.

Words are ASCII lower-cased runs outside ``[\\x20\\x09-\\x0D]``, and each text ends in an end
token, which also stands before its first word.  P(word | before) = share * P(class | class
before) * P(word | class) + (1 - share) * P_base(word), with the add-0.1 unigram of the contract
as base, so the probabilities of all known words and one unknown word sum to one.

Classes: exchange clustering moves the ``head`` most frequent words among ``classes`` classes as
long as the likelihood of the class bigrams grows, on their bigram counts over the whole training
corpus (a bounded table).  Every further frequent word joins the class most likely after the
classes of the head words before it.  Rarer and unknown words are one class, whose members have
smoothed shares of their counts; the end token is another.

Corpus counts cover every training document: word counts are summed by Spark and stored; the
``frequent`` most frequent words go to the tasks; tokens of all others meet their counts in a
join.  A null text is empty, with the end token only.  Without training documents every token
has the base probability 0.1 / 0.1 = 1 and the score 0.  Rows of one doc_id are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldzones.llm import base
from fieldzones.llm.registry import register

CLASSES, HEAD, FREQUENT, ADD, SHARE, PULL = 32, 1000, 1 << 18, 0.1, 0.95, 5.0
END = np.uint64(0x2545F4914F6CDD1D)


def token_stream(data: np.ndarray, offs: np.ndarray):
    """Token hashes (each text's words, then END), and the first token of each text."""
    data = base.LOWER[data]
    s, e, first = base.word_bounds(data, offs, base.SPACE_WORD)
    w = base.word_hashes(data, s, e)
    out = np.insert(w, first[1:], END)
    return out, first + np.arange(len(first))


def each_piece(batches, at: int = 0):
    for rb in batches:
        for a, to, data, offs in base.pieces(rb.column(at)):
            yield rb, a, to, *token_stream(data, offs)


def chunks(names, *columns, size: int = 100_000):
    for i in range(0, max(len(columns[0]), 1), size):
        yield pa.RecordBatch.from_arrays([pa.array(c[i:i + size]) for c in columns], names=names)


def summed(keys: list, values: list):
    """The different keys of several arrays, and the sums of their values."""
    k, v = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(k)
    k, v = k[order], v[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
    return k[at], np.add.reduceat(v, at) if len(at) else v


def word_counts(train: DataFrame, most: int = 2_000_000) -> DataFrame:
    """(word, n) over all rows of ``train`` (column ``text``)."""
    def count(batches):
        keys, n, held = [], [], 0
        for _, _, _, w, _ in each_piece(batches):
            k, c = summed([w], [np.ones(len(w), np.int64)])
            keys.append(k)
            n.append(c)
            held += len(k)
            if held > most:
                k, c = summed(keys, n)
                keys, n, held = [k], [c], len(k)
                if held > most // 2:
                    yield from chunks(["word", "n"], base.signed(k), c)
                    keys, n, held = [], [], 0
        if keys:
            k, c = summed(keys, n)
            yield from chunks(["word", "n"], base.signed(k), c)

    return train.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def cells(train: DataFrame, ids, size: int) -> np.ndarray:
    """Sums over all texts of what ``ids`` gives of (tokens, first): cell numbers below ``size``."""
    def count(batches):
        total = np.zeros(size, np.int64)
        for _, _, _, w, first in each_piece(batches):
            total += np.bincount(ids(w, first), minlength=size)
        at = np.flatnonzero(total)
        yield from chunks(["cell", "n"], at, total[at])

    rows = train.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)  # a table of fixed size, whatever the corpus
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out


def exchange(bigrams: np.ndarray, words: int, classes: int = CLASSES, sweeps: int = 12) -> np.ndarray:
    """Classes of the first ``words`` rows; the further rows are classes of their own."""
    n, c = len(bigrams), classes + len(bigrams) - words
    b = bigrams.astype(float)
    own = np.concatenate([np.arange(words) % classes, np.arange(classes, c)]).astype(int)
    one = np.zeros((n, c))
    one[np.arange(n), own] = 1
    g = one.T @ b @ one
    f = lambda x: x * np.log(np.maximum(x, 1e-12))
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            a, self_ = own[w], b[w, w]
            r = np.bincount(own, b[w], minlength=c)
            left = np.bincount(own, b[:, w], minlength=c)
            r[a] -= self_
            left[a] -= self_
            g[a] -= r
            g[:, a] -= left
            g[a, a] -= self_
            rows, cols = g.sum(axis=1), g.sum(axis=0)
            gain = (f(g + r) - f(g)).sum(axis=1) + (f(g + left[:, None]) - f(g)).sum(axis=0)
            d = np.diag(g)
            gain += f(d + r + left + self_) + f(d) - f(d + r) - f(d + left)
            gain -= f(rows + r.sum() + self_) - f(rows) + f(cols + left.sum() + self_) - f(cols)
            to = int(gain[:classes].argmax())
            if gain[to] <= gain[a] + 1e-9:
                to = a
            g[to] += r
            g[:, to] += left
            g[to, to] += self_
            own[w] = to
            moved += to != a
        if not moved:
            break
    return own


@dataclass
class Model:
    """What a task needs: the frequent words with classes, emissions and base, and transitions."""

    words: base.Lookup
    kind: np.ndarray      # class of each frequent word
    emit: np.ndarray      # its share of the class
    unigram: np.ndarray   # its base probability
    move: np.ndarray      # P(class | class before)
    rare: int             # the class of all other words
    tokens: int           # N
    norm: float           # N + ADD * (V + 1)
    rare_norm: float      # the same over the rare class
    ends: float           # training texts

    def classes(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.words.find(w)
        return at, np.where(at >= 0, self.kind[at], self.rare) if len(self.kind) else np.full(len(w), self.rare)


def befores(kinds: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """The class before each token; ``end`` before the first of each text."""
    out = np.empty_like(kinds)
    out[1:] = kinds[:-1]
    out[first[:-1]] = end
    return out


def fit(train: DataFrame, classes: int = CLASSES, head: int = HEAD, frequent: int = FREQUENT) -> tuple[Model, DataFrame]:
    """The model, and the stored counts (word, n) of all training words."""
    sc = train.sparkSession.sparkContext
    counts = base.stored(word_counts(train))
    bands = counts.groupBy(F.floor(F.log2("n") * 16).alias("band")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()
    n, v = sum(r.n for r in bands), sum(r.v for r in bands)
    norm = n + ADD * (v + 1)
    least, room = 1 << 60, frequent
    for r in sorted(bands, key=lambda r: -r.band):  # whole bands of counts, from the most frequent words
        room -= r.v
        if room < 0:
            break
        least = r.band
    top = counts.where(F.floor(F.log2("n") * 16) >= least).toArrow()  # at most ``frequent`` rows
    keys, times = base.unsigned(top.column("word").to_numpy()), top.column("n").to_numpy().astype(float)
    keep = keys != END
    order = np.argsort(keys[keep])
    keys, times = keys[keep][order], times[keep][order]
    lookup = base.Lookup(keys)
    ranked = np.lexsort([keys, -times])
    head = min(head, len(keys))
    place = np.full(len(keys), head)       # of a head word its rank; other words, then END
    place[ranked[:head]] = np.arange(head)
    rare, end = classes, classes + 1
    sent = sc.broadcast((lookup, place))

    def ids_of(w):
        find, rank = sent.value
        at = find.find(w)
        out = np.where(at >= 0, rank[at], head) if len(rank) else np.full(len(w), head)
        out[w == END] = head + 1
        return at, out

    def bigram_cells(w, first):
        _, i = ids_of(w)
        return befores(i, first, head + 1) * (head + 2) + i

    bigrams = cells(train, bigram_cells, (head + 2) ** 2).reshape(head + 2, head + 2)
    own = exchange(bigrams, head, classes)
    one = np.zeros((head + 2, classes + 2))
    one[np.arange(head + 2), own] = 1
    table = one.T @ bigrams @ one
    kind = np.where(place < head, own[np.minimum(place, head)], rare)

    # Every further frequent word joins the class most likely after the classes before it.
    class_of = sc.broadcast(np.append(own[:head], [rare, end]))

    def contexts(batches):
        held, n_held, size = [], [], 0
        for _, _, _, w, first in each_piece(batches):
            at, i = ids_of(w)
            c = class_of.value[i]
            b = befores(c, first, end)
            use = (at >= 0) & (i == head) & (b != rare)
            k, m = summed([at[use] * (classes + 2) + b[use]], [np.ones(int(use.sum()), np.int64)])
            held.append(k)
            n_held.append(m)
            size += len(k)
            if size > 2_000_000:
                yield from chunks(["cell", "n"], *summed(held, n_held))
                held, n_held, size = [], [], 0
        if held:
            yield from chunks(["cell", "n"], *summed(held, n_held))

    if len(keys) > head:
        log_to = np.log((table[:, :classes] + 0.5) / (table[:, :classes].sum(axis=0, keepdims=True) + 0.5 * (classes + 2)))  # log P(class before | class)
        prior = np.log(table[:, :classes].sum(axis=0) + 1.0)
        after = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in log_to])
        seen = train.select("text").mapInArrow(contexts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        votes = seen.select(F.expr(f"cell div {classes + 2}").alias("at"), (F.col("cell") % (classes + 2)).cast("int").alias("b"), "n")
        row = F.element_at(after, F.col("b") + 1)
        best = votes.select("at", "n", row.alias("row")).groupBy("at").agg(*[F.sum(F.col("n") * F.col("row")[c]).alias(f"c{c}") for c in range(classes)]).toArrow()
        at = best.column("at").to_numpy()  # at most ``frequent`` rows
        scores = np.column_stack([best.column(f"c{c}").to_numpy() for c in range(classes)]) + prior
        kind[at] = scores.argmax(axis=1)

    size = np.bincount(kind, times, minlength=classes + 2)
    rare_v = v - int((kind != rare).sum()) - (1 if n else 0)
    n_end = float(bigrams[:, head + 1].sum())
    rare_n = n - n_end - size.sum() + size[rare]
    model = Model(lookup, kind, np.where(kind == rare, 0.0, times / np.maximum(size[kind], 1)), (times + ADD) / norm, np.zeros((0, 0)), rare, n, norm, rare_n + ADD * (rare_v + 1), n_end)
    model.emit = np.where(kind == rare, (times + ADD) / model.rare_norm, model.emit)
    partly = sc.broadcast(model)

    def class_cells(w, first):
        _, c = partly.value.classes(w)
        c[w == END] = end
        return befores(c, first, end) * (classes + 2) + c

    moves = cells(train, class_cells, (classes + 2) ** 2).reshape(classes + 2, classes + 2).astype(float)
    total = moves.sum()
    unigram = (moves.sum(axis=0) + 0.5) / (total + 0.5 * (classes + 2))
    model.move = (moves + PULL * unigram) / (moves.sum(axis=1, keepdims=True) + PULL)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, share: float = SHARE) -> DataFrame:
    """``docs`` without text, with n_tokens, n_known, train_tokens, base_score and score."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(model)
    carried = [f for f in docs.schema.fields if f.name != "text"]
    end = model.rare + 1

    def run(batches):
        m = sent.value
        share_ = share if m.tokens else 0.0
        end_base = (m.ends + ADD) / m.norm
        row = TaskContext.get().partitionId() << 33
        for rb in batches:
            for a, to, data, offs in base.pieces(rb.column(rb.schema.get_field_index("text"))):
                w, first = token_stream(data, offs)
                at, c = m.classes(w)
                is_end = w == END
                c[is_end] = end
                move = m.move[befores(c, first, end), c]
                known = (at >= 0) | is_end
                p0 = np.where(is_end, end_base, m.unigram[at] if len(m.unigram) else 1.0)
                p1 = share_ * move * np.where(is_end, 1.0, m.emit[at] if len(m.emit) else 1.0) + (1 - share_) * p0
                of = np.repeat(np.arange(to - a), np.diff(first))
                sums = [np.bincount(of[known], x[known], minlength=to - a) for x in (np.ones(len(w)), np.log10(p0), np.log10(p1))]
                rest = ~known
                cut = np.concatenate([[0], np.cumsum(np.bincount(of[rest], minlength=to - a))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rb.column(rb.schema.get_field_index(f.name))[a:to] for f in carried]
                    + [pa.array(row + np.arange(to - a)), pa.array(np.diff(first)), pa.array(sums[0].astype(np.int64) - (0 if m.tokens else 1)), pa.array(sums[1]), pa.array(sums[2]),
                       pa.ListArray.from_arrays(pa.array(cut), pa.array(base.signed(w[rest]))), pa.ListArray.from_arrays(pa.array(cut), pa.array(share_ * move[rest]))],
                    names=[*[f.name for f in carried], "row_", "n_tokens", "n_known", "base_score", "score", "rare_words", "rare_moves"])
                row += to - a

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in carried] + ["row_ long, n_tokens long, n_known long, base_score double, score double, rare_words array<long>, rare_moves array<double>"])
    found = base.stored(docs.mapInArrow(run, schema))
    rest = found.select("row_", F.explode(F.arrays_zip("rare_words", "rare_moves")).alias("r")).select("row_", F.col("r.rare_words").alias("word"), F.col("r.rare_moves").alias("move"))
    n = F.coalesce(F.col("n"), F.lit(0)) + ADD
    p0 = n / model.norm
    p1 = F.col("move") * n / model.rare_norm + (1 - (share if model.tokens else 0.0)) * p0
    rest = rest.join(counts, "word", "left").select("row_", F.col("n").isNotNull().cast("long").alias("n_known"), F.log10(p0).alias("base_score"), F.log10(p1).alias("score"))
    names = [f.name for f in carried] + ["n_tokens"]
    whole = found.select("row_", *[F.struct(*names).alias("doc")], "n_known", "base_score", "score").unionByName(rest.select("row_", F.lit(None).cast(found.select(F.struct(*names).alias("d")).schema["d"].dataType).alias("doc"), "n_known", "base_score", "score"))
    out = whole.groupBy("row_").agg(F.max("doc").alias("doc"), *[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")])
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in names], "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@register("op5_brown_classes")
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", (base.id_remainder(F.col("doc_id"), 10) == 0).alias("held_out"), "text")
    model, counts = fit(docs.where(~F.col("held_out")))
    return score(docs, model, counts)
