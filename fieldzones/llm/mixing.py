"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its weight's share of all words, at most ``CAP`` times its own words; what
is above goes to the other sources by weight until none is above (one level for all sources,
found by a few aggregates over the table of sources).  A document's expected copies are target /
source words: the whole part is certain, the fraction is a copy probability.

Pivotal rounding settles the fractions without losing words: a document of a source duels with
the next (with several, if they are much smaller), and words move from one's probability to the
other's, in a direction drawn so that expectations stay, until one is 0 or 1; the others go on.  Each source's documents are dealt to leaves
of about ``LEAF`` documents by a hash, every leaf leaves one open document at most, and these
residuals meet in a tree of ``FAN`` nodes to one until each source has one, which is rounded.
So a source misses its target by less than the size of one document.  Duels go from large to
small documents, which leaves a small one open.  Draws are hashes of the documents: reruns
agree, whatever the partitions.

Null text: size 0, no words taken.  A null source is a source (the last).  Repeated rows are
documents of their own.  Without any word all targets are 0.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldzones.llm import base
from fieldzones.llm.registry import register

CAP, LEAF, FAN = 3.0, 4096, 64
_OPEN = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash and size (words) of every row."""
    def count(batches):
        for rb in batches:
            n = np.zeros(len(rb), np.int64)
            for a, to, data, offs in base.pieces(rb.column(3)):
                n[a:to] = np.diff(base.word_bounds(data, offs, base.SPACE_WORD)[2])
            yield pa.RecordBatch.from_arrays([*rb.columns[:3], pa.array(n)], names=["doc_id", "source", "text_hash", "size"])

    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), "text")
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "source"))
    return rows.mapInArrow(count, f"{kinds}, text_hash long, size long")


def ranked(table: DataFrame, column: str) -> DataFrame:
    """``table`` with ``rank``, the place (from 0) of its rows by ``column``, null last: sorted in
    ranges, which are counted, so no task gets all rows."""
    rows = base.stored(table.repartitionByRange(F.col(column).asc_nulls_last()).sortWithinPartitions(F.col(column).asc_nulls_last())
                       .withColumn("part_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = {r.part_: r.n for r in rows.groupBy("part_").agg(F.count("*").alias("n")).collect()}  # partitions
    before = np.concatenate([[0], np.cumsum([counts.get(i, 0) for i in range(max(counts, default=-1) + 1)])])
    start = F.array(*[F.lit(int(x)) for x in before])
    return rows.withColumn("rank", F.get(start, F.col("part_")) + F.col("at_")).drop("part_", "at_")


def targets(sized: DataFrame, weights: Column | None = None, cap: float = CAP) -> DataFrame:
    """source, n, source_size and target of every source.  ``weights`` may use ``rank``."""
    by_source = ranked(sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), "source")
    weight = F.col("rank") % 3 + 1 if weights is None else weights
    by_source = base.stored(by_source.withColumn("weight", weight.cast("double")))
    total = by_source.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # a source is full if its share at this level is over its cap
    while True:
        full = F.col("weight") * level >= F.col("source_size") * cap
        row = by_source.agg(F.sum(F.when(full, F.col("source_size") * cap)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        after = (total - (row.full or 0.0)) / row.w if row.w else level
        if after <= level * (1 + 1e-15):
            break
        level = after
    return by_source.select("source", "n", "source_size", F.least(F.col("weight") * level, F.col("source_size") * cap).alias("target"))


def duel(h: np.ndarray, size: np.ndarray, p: np.ndarray, last: bool) -> np.ndarray:
    """Probabilities after pivotal rounding in the given order; all but one are 0 or 1.  With
    ``last`` that one is rounded too.  A document meets as many of the next ones as it takes to
    settle it in either direction; they give or take words in proportion."""
    p = p.copy()
    u = (base.mix(h ^ np.uint64(0x6A09E667F3BCC909)) >> np.uint64(11)).astype(float) / float(1 << 53)
    free = (size == 0) & (p > _OPEN) & (p < 1 - _OPEN)
    p[free] = u[free] < p[free]
    order = np.flatnonzero((p > _OPEN) & (p < 1 - _OPEN))
    draw = 0
    for k, i in enumerate(order):
        to = k + 1
        while _OPEN < p[i] < 1 - _OPEN:
            up, down = (1 - p[i]) * size[i], p[i] * size[i]  # words that settle it
            room = sum(size[j] * p[j] * (1 - p[j]) for j in order[k + 1:to])
            while to < len(order) and room < max(up, down):
                j = order[to]
                room, to = room + size[j] * p[j] * (1 - p[j]), to + 1
            others = order[k + 1:to]
            others = others[(p[others] > _OPEN) & (p[others] < 1 - _OPEN)]
            if not len(others):
                break  # the last open document
            # the others share the words in one fixed proportion, so no expectation moves
            q = p[others]
            room = float((size[others] * q * (1 - q)).sum())
            up, down = min(up, (room / (1 - q)).min()), min(down, (room / q).min())
            draw += 1
            u = float(base.mix(h[i:i + 1] ^ np.uint64(draw * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))[0] >> np.uint64(11)) / float(1 << 53)
            move = up if u * (up + down) < down else -down
            p[i] += move / size[i]
            p[others] -= move * q * (1 - q) / room
    left = (p > _OPEN) & (p < 1 - _OPEN)
    if last:
        p[left] = p[left] >= 0.5
    settled = (p <= _OPEN) | (p >= 1 - _OPEN)
    p[settled] = np.round(p[settled])
    return p


def mix(sized: DataFrame, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """``sized`` (doc_id, source, text_hash, size) with source_size, target and ``copies``."""
    sized = base.stored(sized)
    sources = base.stored(targets(sized)).withColumnRenamed("source", "source_")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    h = F.xxhash64("doc_id", "text_hash", "size")
    rows = sized.join(sources, F.col("source").eqNullSafe(F.col("source_"))).select(
        "doc_id", "source", "text_hash", "size", "source_size", "target", F.floor(ratio).cast("int").alias("whole"), (ratio - F.floor(ratio)).alias("p"),
        h.alias("h"), F.pmod(F.xxhash64(h, F.lit(2)), F.ceil(F.col("n") / leaf)).alias("node"), F.ceil(F.col("n") / leaf).alias("nodes"))
    schema = rows.schema
    levels, most = 1, sources.agg(F.max(F.ceil(F.col("n") / leaf))).first()[0] or 0
    while most > 1:
        levels, most = levels + 1, -(-most // fan)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "h"], ascending=[False, True], kind="stable")
        p = duel(pdf["h"].to_numpy().view(np.uint64), pdf["size"].to_numpy().astype(float), pdf["p"].to_numpy(), int(pdf["nodes"].iloc[0]) <= 1)
        return pdf.assign(p=p)

    done = []
    for _ in range(levels):
        rows = base.stored(rows.groupBy("source", "node").applyInPandas(settle, schema))
        settled = F.col("p").isin(0.0, 1.0)
        done.append(rows.where(settled))
        rows = rows.where(~settled).withColumn("node", F.floor(F.col("node") / fan)).withColumn("nodes", F.ceil(F.col("nodes") / fan))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", (F.col("whole") + F.col("p")).cast("int").alias("copies"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, with its columns and the
    number of the row among them in ``copy`` (1, 2, 3; ``copy_`` if the documents have a copy)."""
    base.prepare(spark)
    taken = mix(sizes(docs)).groupBy(F.col("doc_id").alias("_llm_id"), F.col("text_hash").alias("_llm_hash"), F.col("source").alias("_llm_source")).agg(F.sort_array(F.collect_list("copies")).alias("_llm_copies"))
    rows = docs.withColumn("_llm_own", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_llm_id")) & (F.col("_llm_own") == F.col("_llm_hash")) & F.col("source").eqNullSafe(F.col("_llm_source"))
    # rows of one id, text and source: each gets a count of its own from the list
    number = F.row_number().over(Window.partitionBy("_llm_id", "_llm_hash", "_llm_source").orderBy("_llm_hash"))
    rows = rows.join(taken, same).withColumn("_llm_times", F.get("_llm_copies", number - 1)).where("_llm_times > 0")
    name = "copy" if "copy" not in [c.lower() for c in docs.columns] else "copy_"
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), "_llm_times")).alias(name))


@register("op4_pivotal_rounding")
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(sizes(base.table(spark, sf_dir, "documents")))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
