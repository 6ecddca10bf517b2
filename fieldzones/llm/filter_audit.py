"""Filter interaction audit over a sparse document-term matrix.

Words are encoded by one dictionary of the whole table.  Each task turns its documents into
shards of at most ``SHARD_BYTES`` of text, in compressed sparse rows over the shard's own word
list; the lists of all shards are dealt into ``BUCKETS`` by hash and numbered there in sorted
order (a word's number is ``rank * BUCKETS + bucket``, the same in every shard), and the numbers
go back into the shards.  Row sums of a shard are words of its documents, nonzero entries its
different words; these decide filters A and B.  C and D are read off the text, E from the least
doc_id of each text's SHA-256.  Documents are then counted by part and by the set of filters they
fail (32 at most), so that all orders of the filters are read off counts, not documents:

* kept after a step: fails none of the filters so far; removed: fails this one first;
* redundant: fails this one, removed earlier; unique_fails: fails this one only;
* shapley: a document failing k filters meets a given one of them first in 120 / k of 120 orders.

A word is in one shard list once, so the hottest word is one row for each shard; a hot part or
text is aggregated before it is shuffled.  A shard is bounded by bytes and only a longer text
exceeds it (a shard of its own, which has to fit into one task).

Null text: empty, fails A only (0 < 0 is false for B).  Null source: part ''.  A null doc_id comes
after all others (never the smaller one), and has no labels.  Repeated rows are documents of
their own; rows of one doc_id and text are not smaller than each other, so they fail E only if
another id is.  Several labels of one doc_id: any quality or toxic of 1 counts; none or null:
no label.  Columns other than doc_id, text and source are not read, so their names cannot
clash.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldzones.llm import base
from fieldzones.llm.registry import register

SHARD_BYTES = 16 << 20
BUCKETS = 1 << 14
FILTERS = "ABCDE"
_CAPITALS = bytes(range(65, 91))
_SIGNS = tuple(b"#$%&*|")

SHARDS = ("shard long, words array<binary>, doc_id array<long>, part array<string>, digest array<binary>, "
          "other array<int>, starts array<int>, columns binary, counts binary")
MATRIX = ("shard long, doc_id array<long>, part array<string>, digest array<binary>, other array<int>, "
          "starts array<int>, numbers array<long>, counts array<int>")
ROWS = "doc_id long, part string, digest binary, fails int, n_words long, n_distinct long"


def pack(x: np.ndarray) -> bytes:
    """Numbers of a shard as compressed differences."""
    planes = np.diff(x, prepend=x.dtype.type(0)).astype("<i4", copy=False).view(np.uint8).reshape(-1, 4).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel(), dtype=np.int32)


def shards_of(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Sparse rows over each shard's own word list, packed; ``other``: the bits of C (4) and D (8)."""
    names = [x.split()[0] for x in SHARDS.split(", ")]

    def run(batches):
        seed = TaskContext.get().partitionId() << 32
        made, size = 0, 0
        held = None

        def fresh():
            number = itertools.count()
            return {"of": defaultdict(number.__next__), "id": [], "part": [], "digest": [], "other": [], "columns": [], "counts": []}

        def out():
            sizes = [len(x) for x in held["columns"]]
            flat = lambda k: pack(np.concatenate(held[k]))
            row = [seed + made, list(held["of"]), held["id"], held["part"], held["digest"], held["other"], np.cumsum([0, *sizes]).astype(np.int32), flat("columns"), flat("counts")]
            kinds = [pa.int64(), *[pa.list_(t) for t in (pa.binary(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int32())], pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)

        for rb in batches:
            ids, parts = rb.column(0).to_pylist(), rb.column(2).to_pylist()
            for k, text in enumerate(rb.column(1)):
                raw = (text.as_py() or "").encode()
                if held is None or size and size + len(raw) > shard_bytes:
                    if held is not None:
                        yield out()
                        made, size = made + 1, 0
                    held = fresh()
                words = raw.split()
                columns, counts = np.unique(np.fromiter(map(held["of"].__getitem__, words), np.int32, len(words)), return_counts=True)
                n_chars = len(raw) if raw.isascii() else len(raw.decode())
                capitals = len(raw) - len(raw.translate(None, _CAPITALS))
                size += len(raw)
                held["id"].append(ids[k])
                held["part"].append(parts[k] or "")
                held["digest"].append(hashlib.sha256(raw).digest())
                held["other"].append(4 * (100 * capitals > 5 * n_chars) + 8 * any(b in raw for b in _SIGNS))
                held["columns"].append(columns)
                held["counts"].append(counts.astype(np.int32))
        if held is not None:
            yield out()

    return docs.select("doc_id", "text", "source").mapInArrow(run, SHARDS)


def numbered(shards: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """shard, places, numbers: the dictionary's number of each word of each shard's list."""
    words = shards.select("shard", F.posexplode("words").alias("place", "word"))
    words = words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("word"))
    words = words.select("shard", "place", ((rank - 1) * buckets + F.col("bucket")).alias("number"))
    return words.groupBy("shard").agg(F.collect_list("place").alias("places"), F.collect_list("number").alias("numbers"))


def term_matrix(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The document-term matrix of ``docs`` (doc_id, text, source) as rows of ``MATRIX``: row i of a
    shard has ``counts`` of the words ``numbers`` at starts[i] to starts[i + 1]."""
    shards = base.stored(shards_of(docs, shard_bytes))

    def encode(batches):
        for rb in batches:
            for k in range(len(rb)):
                value = {c: rb.column(i)[k] for i, c in enumerate(columns)}
                places = value["places"].values
                number = np.zeros(0 if places is None else len(places), np.int64)
                if len(number):
                    number[places.to_numpy()] = value["numbers"].values.to_numpy()
                n = value["starts"].values[-1].as_py()
                value["numbers"] = number[unpack(value["columns"].as_py(), n)]
                value["counts"] = unpack(value["counts"].as_py(), n)
                yield pa.RecordBatch.from_arrays([pa.array([value[c] if isinstance(value[c], np.ndarray) else value[c].as_py()], t) for c, t in kinds.items()], names=list(kinds))

    lists = [pa.list_(t) for t in (pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int32())]
    kinds = dict(zip([x.split()[0] for x in MATRIX.split(", ")], [pa.int64(), *lists]))
    both = shards.drop("words").join(numbered(shards), "shard", "left")
    columns = both.columns
    return both.mapInArrow(encode, MATRIX)


def measured(matrix: DataFrame) -> DataFrame:
    """A row for each document: its words, different words and the bits of A (1) to D (8)."""
    names = [x.split()[0] for x in ROWS.split(", ")]

    def run(batches):
        for rb in batches:
            for k in range(len(rb)):
                doc_id, part, digest, other, starts, _, counts = (rb.column(c)[k].values for c in range(1, 8))
                starts, total = starts.to_numpy(), np.append(0, np.cumsum(counts.to_numpy(), dtype=np.int64))
                n_words, n_distinct = np.diff(total[starts]), np.diff(starts).astype(np.int64)
                fails = other.to_numpy() | (n_words < 50) * 1 | (100 * n_distinct < 65 * n_words) * 2
                for a in range(0, len(fails), 20_000):
                    at = slice(a, a + 20_000)
                    yield pa.RecordBatch.from_arrays([doc_id[at], part[at], digest[at], pa.array(fails[at].astype(np.int32)), pa.array(n_words[at]), pa.array(n_distinct[at])], names=names)

    return matrix.mapInArrow(run, ROWS)


def failures(docs: DataFrame) -> DataFrame:
    """``measured`` with E's bit (16): the text is also that of a smaller doc_id."""
    rows = base.stored(measured(term_matrix(docs)))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))  # one row for each text
    first = first.select(F.col("digest").alias("digest_"), F.col("doc_id").alias("first_"))
    found = rows.join(first, (F.col("digest") == F.col("digest_")) & F.col("doc_id").eqNullSafe(F.col("first_")), "left")
    return found.select(*rows.columns, F.col("digest_").isNull().alias("fails_e")).withColumn(
        "fails", F.col("fails") + F.when(F.col("fails_e"), 16).otherwise(0)).drop("fails_e")


def steps(spark: SparkSession) -> DataFrame:
    """Fixed 120 x 5 x 32 rows: what happens at each step of each order to a document that fails
    just the filters of ``fails``."""
    rows = []
    for order in itertools.permutations(range(5)):
        for fails in range(32):
            before = 0
            for k, f in enumerate(order):
                bit = 1 << f
                hit, earlier = bool(fails & bit), bool(fails & before)
                before |= bit
                rows.append((fails, "".join(FILTERS[x] for x in order), k + 1, int(not fails & before), int(hit and not earlier), int(hit and earlier),
                             int(fails == bit), 120 // fails.bit_count() if hit else 0))
    return spark.createDataFrame(rows, "fails int, filter_order string, step int, kept_ int, removed_ int, redundant_ int, unique_ int, shapley_ int")


def audit(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of ``failed`` (part, fails, doc_id) by part, order of the filters and step."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id_")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = failed.select("doc_id", "part", "fails").join(marks, F.col("doc_id") == F.col("id_"), "left")
    sets = rows.groupBy("part", "fails").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    found = sets.join(F.broadcast(steps(failed.sparkSession)), "fails")  # 19,200 rows
    total = lambda n, role: F.sum(F.col(n) * F.col(role))
    return found.groupBy("part", "filter_order", "step").agg(
        total("n", "kept_").alias("kept"), total("n", "removed_").alias("removed"), total("n", "redundant_").alias("redundant"),
        total("n", "unique_").alias("unique_fails"), total("good", "removed_").alias("good_lost"),
        total("toxic", "removed_").alias("toxic_lost"), total("n", "shapley_").alias("shapley"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
f AS (SELECT doc_id, part,
      (len(w) < 50)::INT AS a, (100 * len(list_distinct(w)) < 65 * len(w))::INT AS b,
      (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT AS c,
      regexp_matches(t, '[#$%&*|]')::INT AS d,
      (first_id IS NOT NULL AND (doc_id IS NULL OR first_id < doc_id))::INT AS e FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
s AS (SELECT part, a, b, c, d, e, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
      FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
      WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
st AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INT AS step FROM o),
r AS (SELECT s.*, filter_order, step,
      CASE substr(filter_order, step, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS hit,
      list_sum([CASE ch WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END FOR ch IN string_split(substr(filter_order, 1, step - 1), '') IF ch <> '']) AS prior,
      a + b + c + d + e AS k FROM s, st),
g AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, sum(CASE WHEN hit = 0 AND coalesce(prior, 0) = 0 THEN n ELSE 0 END) AS kept,
      sum(CASE WHEN hit = 1 AND coalesce(prior, 0) = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit = 1 AND prior > 0 THEN n ELSE 0 END) AS redundant,
      sum(CASE WHEN hit = 1 AND k = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit = 1 AND coalesce(prior, 0) = 0 THEN good ELSE 0 END) AS good_lost,
      sum(CASE WHEN hit = 1 AND coalesce(prior, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM g
"""


@register("op13_filter_audit", ORACLE)
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failures(base.table(spark, sf_dir, "documents")), base.table(spark, sf_dir, "labels"))
