"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each text gives the statistics ``FEATURES`` (numpy over the bytes of a batch).  Trees are grown
level by level on histograms of quantile bins with logistic loss, from a bounded sample of
labelled documents (``sample`` rows in expectation, taken by a hash of doc_id), and flattened
into five arrays, which a batch walks in lockstep, all rows and trees one level at a time.

Null text counts as empty and gets the score of its statistics (all 0), as every text does.
Several labels of one document: the greatest.  Labels that are null or have no document are
ignored; without two classes to learn from, every score is the share of class 1 (0.5 if none).
Repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldzones.llm import base
from fieldzones.llm.registry import register

SAMPLE, TREES, DEPTH, BINS, RATE, L2, LEAST = 20_000, 60, 4, 64, 0.15, 1.0, 5.0
THRESHOLD = 0.7
_CLASSES = {"symbols": b"#*$%&<>", "bars": b"|", "digits": b"0123456789", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "spaces": b" \t", "lines": b"\n", "stops": b".,;:", "bangs": b"!?", "marks": b"'\"()[]{}-_/\\@^~`+="}
_KIND = np.zeros(256, np.uint8)
for _k, _bytes in enumerate(_CLASSES.values()):
    _KIND[list(_bytes)] = _k + 1
_KIND[128:] = len(_CLASSES) + 1
_KINDS = [*(f"{name}_share" for name in _CLASSES), "high_share"]
FEATURES = ["log_bytes", "log_words", "word_length", "word_length_spread", "short_words", "long_words", "distinct_words", "repeated_windows", "repeated_lines", "line_length", "top_word", *_KINDS]


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """FEATURES of each text, one row a text."""
    n, size = len(offs) - 1, np.diff(offs)
    text = np.repeat(np.arange(n), size)
    kinds = np.bincount(text * 16 + _KIND[data], minlength=n * 16).reshape(n, 16)[:, 1:len(_KINDS) + 1]
    starts, ends, first = base.word_bounds(data, offs, base.SPACE_WORD)
    words, of = np.diff(first), np.repeat(np.arange(n), np.diff(first))
    long = ends - starts
    some = np.maximum(words, 1)
    per = lambda x: np.bincount(of, x, minlength=n) / some
    mean = per(long)
    hashes = base.word_hashes(base.LOWER[data], starts, ends)

    def groups(h, own):
        """Of equal hashes in a text: the text, and how many."""
        key = base.mix(h + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        k = key[order]
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
        return own[order[at]], np.diff(np.append(at, len(k)))

    own, times = groups(hashes, of)
    top = np.zeros(n)
    np.maximum.at(top, own, times)
    grams = base.window_hashes(hashes, 5)
    inside = of[:len(grams)] == of[4:] if len(grams) else np.zeros(0, bool)
    own5, times5 = groups(grams[inside], of[:len(grams)][inside])
    l0, l1, lf = base.word_bounds(data, offs, _NOT_NEWLINE)
    lof = np.repeat(np.arange(n), np.diff(lf))
    lown, ltimes = groups(base.word_hashes(data, l0, l1), lof)
    lines = np.maximum(np.diff(lf), 1)
    return np.column_stack([
        np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(per(long.astype(float) ** 2) - mean ** 2, 0)),
        per(long <= 2), per(long > 15), np.bincount(own, minlength=n) / some,
        np.bincount(own5, times5 - 1, minlength=n) / np.maximum(words - 4, 1),
        np.bincount(lown, ltimes - 1, minlength=n) / lines, np.log1p(words / lines), top / some,
        kinds / np.maximum(size, 1)[:, None]]).astype(np.float32)


_NOT_NEWLINE = ~base.byte_set(b"\n")


def featurise(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row, as one array."""
    def run(batches):
        for rb in batches:
            x = [statistics(data, offs) for _, _, data, offs in base.pieces(rb.column(1), rows=4096)]
            flat = np.concatenate(x).ravel() if x else np.zeros(0, np.float32)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(rb) + 1, dtype=np.int32) * len(FEATURES)), pa.array(flat))], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<float>")


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> dict:
    """Flattened trees: a node's feature (-1: leaf), cut, children and value; roots; base score."""
    n, m = x.shape
    share = float(y.mean()) if n else 0.5
    model = {k: [] for k in ("feature", "cut", "left", "right", "value")} | {"roots": [], "start": 0.0}
    if n == 0 or share in (0.0, 1.0):
        model["start"] = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return {k: np.array(v) for k, v in model.items()}
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    model["start"] = float(np.log(share / (1 - share)))
    score = np.full(n, model["start"])

    def node(**v):
        for k in ("feature", "cut", "left", "right", "value"):
            model[k].append(v.get(k, -1 if k != "cut" else 0.0))
        return len(model["value"]) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        root = node(value=0.0)
        model["roots"].append(root)
        level, where = [root], np.full(n, root)
        for d in range(depth + 1):
            nxt = []
            for nd in level:
                rows = np.flatnonzero(where == nd)
                gs, hs = g[rows].sum(), h[rows].sum()
                model["value"][nd] = -rate * gs / (hs + L2)
                best = (1e-6, None, None)
                if d < depth and hs > 0 and len(rows) >= 2 * LEAST:
                    for j in range(m):
                        if not len(cuts[j]):
                            continue
                        c = code[rows, j]
                        gl = np.cumsum(np.bincount(c, g[rows], minlength=len(cuts[j]) + 1))[:-1]
                        hl = np.cumsum(np.bincount(c, h[rows], minlength=len(cuts[j]) + 1))[:-1]
                        nl = np.cumsum(np.bincount(c, minlength=len(cuts[j]) + 1))[:-1]
                        gain = gl ** 2 / (hl + L2) + (gs - gl) ** 2 / (hs - hl + L2) - gs ** 2 / (hs + L2)
                        gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], j, k)
                if best[1] is not None:
                    _, j, k = best
                    a, b = node(value=0.0), node(value=0.0)
                    model["feature"][nd], model["cut"][nd], model["left"][nd], model["right"][nd] = j, float(cuts[j][k]), a, b
                    goes = code[rows, j] <= k
                    where[rows[goes]], where[rows[~goes]] = a, b
                    nxt += [a, b]
            level = nxt
        score += np.array(model["value"])[where]
    return {k: np.array(v) for k, v in model.items()}


def walk(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of rows of statistics."""
    score = np.full(len(x), float(model["start"]))
    if len(model["roots"]) and len(x):
        at = np.broadcast_to(model["roots"], (len(x), len(model["roots"]))).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            f = model["feature"][at]
            if (f < 0).all():
                break
            down = np.where(x[rows, np.maximum(f, 0)] <= model["cut"][at], model["left"][at], model["right"][at])
            at = np.where(f < 0, at, down)
        score += model["value"][at].sum(axis=1)
    return 1 / (1 + np.exp(-score))


def fit(features: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> dict:
    """Trees from at most about ``sample`` labelled rows of ``features`` (doc_id, x)."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    n = known.count()
    known = known.where(base.hash_share(F.col("doc_id"), 9) < float(sample) / max(n, 1))
    rows = features.join(F.broadcast(known), "doc_id").select("doc_id", "x", "y").toPandas()  # bounded by ``sample``
    x = np.array(rows["x"].tolist(), np.float32).reshape(-1, len(FEATURES))
    y = rows["y"].to_numpy(float)
    order = np.lexsort([*x.T, y, rows["doc_id"].to_numpy()])
    return grow(x[order], y[order])


def score(features: DataFrame, model: dict) -> DataFrame:
    """``features`` (columns of which ``x``) with ``score`` in place of ``x``."""
    sent = features.sparkSession.sparkContext.broadcast(model)
    carried = [f for f in features.schema.fields if f.name != "x"]

    def run(batches):
        for rb in batches:
            x = rb.column(rb.schema.get_field_index("x"))
            flat = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([rb.column(rb.schema.get_field_index(f.name)) for f in carried] + [pa.array(walk(sent.value, flat))], names=[*[f.name for f in carried], "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in carried] + ["score double"])
    return features.mapInArrow(run, schema)


@register("op9_boosted_trees")
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = base.stored(featurise(base.table(spark, sf_dir, "documents")))
    labels = base.table(spark, sf_dir, "labels").where(base.id_remainder(F.col("doc_id"), 4) != 2)
    found = score(features, fit(features, labels, "quality"))
    return found.select("doc_id", (base.id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
