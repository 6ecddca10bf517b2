from pyspark.sql import types as T

from fieldzones import llm

SPACE = r"[^\x20\x09-\x0D]+"
DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    *[T.StructField(c, T.StringType()) for c in ("size", "score", "key", "node", "text_key", "did", "mark", "copy", "host", "n_words")]])
VOCABULARY = {"en": "the of and river stone light under winter house paper green cloud".split(),
              "de": "der die und fluß stein licht unter haus papier grün wolke schön".split()}


def sentence(rng, lang, n):
    return " ".join(rng.choice(VOCABULARY[lang]) + rng.choice(["", "", "en", "ly", "ung"]) + rng.choice(["", ",", "."]) for _ in range(n))


def build(spark, folder, rows, labels=(), benchmark=(), conversations=()):
    """Tables with extra columns; rows are (doc_id, text, lang, source)."""
    docs = [(i, t, lang, s, None if t is None else len(t), *["x"] * 10) for i, t, lang, s in rows]
    spark.createDataFrame(docs, DOCUMENT).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int, score string").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(conversations), "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    return str(folder)


def rows_of(spark, name, folder):
    return [r.asDict() for r in llm.QUERIES[name](spark, folder).collect()]


def water(sizes):
    """Targets by the contract: weights 1, 2, 3 by code point, capped at three times the size."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out | {s: left * w[s] / sum(w[x] for x in free) for s in free}
