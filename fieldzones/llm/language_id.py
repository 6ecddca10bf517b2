"""Language identification by nearest centroid.

A text becomes a vector of its byte 2- and 3-grams: ASCII is lower-cased, every byte that is
neither an ASCII letter nor part of a longer character is a space, runs of spaces are one, and
grams are hashed to ``DIMS`` places.  Counts get a square root, are weighted by inverse document
frequency over all training documents, and scaled to length one.  Each language has up to
``clusters`` centroids (spherical k-means over at most about ``per_language`` of its documents,
taken by a hash of doc_id), and a text gets the language of the centroid with the greatest
cosine.  A text whose cosine distance from that centroid is beyond the centroid's radius (the
farthest training member plus a margin, at least ``LEAST_RADIUS`` so that short texts, whose
vectors are sparse, stay) is rejected.

The score is the cosine, 0 to 1.  Null texts and texts without a letter: ``und``, score 0,
rejected.  Without any training document every text is ``und``.  Ties go to the language that
sorts first.  Rows with a null lang are predicted but not learned from; the query predicts
repeated rows alike.  At most ``MAX_LANGUAGES`` languages can be learned (else an error).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldzones.llm import base
from fieldzones.llm.registry import register

DIMS, MAX_LANGUAGES = 8192, 1000
PER_LANGUAGE, CLUSTERS, MARGIN, LEAST_RADIUS = 400, 4, 0.05, 0.9
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The hashed gram counts of each text, one row a text."""
    n = len(offs) - 1
    b = _FOLD[data]
    text = np.repeat(np.arange(n), np.diff(offs))
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (text[1:] != text[:-1])
    b, text = b[keep].astype(np.uint32), text[keep]
    out = np.zeros(n * DIMS, np.float32)
    for width in (2, 3):
        if len(b) < width:
            continue
        m = len(b) - width + 1
        gram = np.full(m, width, np.uint32)
        for j in range(width):
            gram = gram * np.uint32(0x01000193) ^ b[j:j + m] * np.uint32(0x9E3779B1)
        gram ^= gram >> np.uint32(15)
        whole = text[:m] == text[width - 1:]
        out += np.bincount(text[:m][whole] * DIMS + (gram[whole] * np.uint32(0x85EBCA6B) >> np.uint32(19)).astype(np.int64), minlength=n * DIMS)
    one = np.flatnonzero(np.bincount(text, minlength=n) == 1)  # a single letter has no gram
    if len(one):
        first = np.searchsorted(text, one)
        out[one * DIMS + b[first].astype(np.int64)] += 1
    return out.reshape(n, DIMS)


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(c) * idf
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, seeded by the farthest point from the seeds before; centroids and radii."""
    seeds = [v.mean(axis=0)]
    near = v @ (seeds[0] / max(np.linalg.norm(seeds[0]), 1e-12))
    seeds = [v[int(near.argmax())]]
    for _ in range(min(k, len(v)) - 1):
        seeds.append(v[int(np.max(v @ np.array(seeds).T, axis=1).argmin())])
    c = np.array(seeds)
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        new = np.array([v[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        done = np.abs(new - c).max() < 1e-5
        c = new
        if done:
            break
    cos = v @ c.T
    own = cos.argmax(axis=1)
    radius = np.array([1 - cos[own == j, j].min() if (own == j).any() else 0.0 for j in range(len(c))])
    return c.astype(np.float32), radius


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Documents, and for each place those that have it, over all rows (column ``text``)."""
    def count(batches):
        n, df = 0, np.zeros(DIMS, np.int64)
        for rb in batches:
            for a, to, data, offs in base.pieces(rb.column(0), rows=256):
                n += to - a
                df += (counts(data, offs) > 0).sum(axis=0)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["place", "n"])

    rows = texts.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    found = {r.place: r.n for r in rows}  # DIMS + 1 rows at most
    n, df = found.pop(-1, 0), np.zeros(DIMS)
    df[list(found)] = list(found.values())
    return n, df


def fit(train: DataFrame, per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS, margin: float = MARGIN) -> dict:
    """A model from the columns ``doc_id, text, lang`` of rows to learn from."""
    train = train.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return {"languages": [], "of": np.zeros(0, int), "centroids": np.zeros((0, DIMS), np.float32), "radius": np.zeros(0), "idf": np.ones(DIMS, np.float32)}
    n, df = document_frequencies(train)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    share = F.create_map(*[x for lang, m in sizes.items() for x in (F.lit(lang), F.lit(float(per_language) / m))])
    sample = train.where(base.hash_share(F.col("doc_id"), 3) < share[F.col("lang")])

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"], kind="stable")
        v = []
        for _, _, data, offs in base.pieces(pa.array(pdf["text"], pa.string()), rows=256):
            v.append(vectors(counts(data, offs), idf))
        c, r = cluster(np.concatenate(v), clusters)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "part": range(len(c)), "centre": [x.tobytes() for x in c], "radius": r})

    rows = sample.groupBy("lang").applyInPandas(centroids, "lang string, part int, centre binary, radius double").collect()
    rows.sort(key=lambda r: (r.lang, r.part))  # clusters of at most MAX_LANGUAGES languages
    languages = sorted({r.lang for r in rows})
    return {"languages": languages, "of": np.array([languages.index(r.lang) for r in rows], int), "idf": idf,
            "centroids": np.array([np.frombuffer(r.centre, np.float32) for r in rows], np.float32).reshape(-1, DIMS),
            "radius": np.array([min(max(r.radius + margin, LEAST_RADIUS), 0.99) for r in rows])}


def predict(model: dict, column, has_letter: np.ndarray):
    """Language, cosine and rejection of each text of an Arrow column."""
    n = len(column)
    lang, score, out = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
    if model["languages"]:
        names = np.array(model["languages"], object)
        for a, to, data, offs in base.pieces(column, rows=256):
            cos = vectors(counts(data, offs), model["idf"]) @ model["centroids"].T
            best = cos.argmax(axis=1)
            top = np.clip(cos[np.arange(len(best)), best], 0.0, 1.0)
            ok = has_letter[a:to]
            lang[a:to][ok] = names[model["of"][best]][ok]
            score[a:to][ok] = top[ok]
            out[a:to][ok] = (1 - top > model["radius"][best])[ok]
    return lang, score, out


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` without text, with ``lang_pred``, ``score`` and ``rejected``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.withColumn("has_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    carried = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches):
        for rb in batches:
            flag = rb.column(rb.schema.get_field_index("has_letter")).to_numpy(zero_copy_only=False).astype(bool)
            lang, score, out = predict(sent.value, rb.column(rb.schema.get_field_index("text")), flag)
            yield pa.RecordBatch.from_arrays([rb.column(rb.schema.get_field_index(f.name)) for f in carried] + [pa.array(lang, pa.string()), pa.array(score), pa.array(out)], names=[*[f.name for f in carried], "lang_pred", "score", "rejected"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in carried] + ["lang_pred string", "score double", "rejected boolean"])
    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for rb in batches:
            text = rb.column(rb.schema.get_field_index("text"))
            flag = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False).astype(bool)
            yield rb.filter(pa.array(~predict(sent.value, text, flag)[2]))

    return docs.mapInArrow(run, docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of a known language, with all their columns."""
    base.prepare(spark)
    return accepted(docs, fit(docs.where(base.id_remainder(F.col("doc_id"), 3) != 1)))


@register("op3_nearest_centroid")
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").withColumn("held_out", base.id_remainder(F.col("doc_id"), 3) == 1)
    model = fit(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model)
