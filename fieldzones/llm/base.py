"""Shared helpers: reading tables, shared intermediate tables, and texts as byte arrays.

Tokenising works on the UTF-8 bytes of a whole Arrow batch at once.  Words are identified by
a 64-bit hash of their bytes; two different words of a corpus share a hash with a probability
of about V^2 / 2^65 (V: distinct words), 10^-7 at two million words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldzones.session import cut_lineage

U64 = np.uint64
#: Documents of one Arrow batch and its bytes: what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: evaluated once, and a lost
    executor afterwards costs only a read."""
    return cut_lineage(df)


def id_remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text (null: empty text), modulo ``m``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def hash_share(column: Column, seed: int) -> Column:
    """A reproducible number in [0, 1) from a column's value."""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


# ---------------------------------------------------------------------------- bytes of texts

def byte_set(pattern_bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(pattern_bytes)] = True
    return t


_SPACES = [0x20, *range(0x09, 0x0E)]
#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACE_WORD = ~byte_set(_SPACES)
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM_WORD = ~byte_set([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
BYTE_KEYS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
WORD_KEYS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | U64(1)
_LONG_WORD = 48


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column, one after the other, and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offs = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def pieces(column, most: int = 2 << 20, rows: int = 1 << 20):
    """(first row, last row + 1, bytes, offsets) of runs of at most ``rows`` rows and about
    ``most`` bytes, so that arrays over them stay small; a longer text is a run of its own."""
    data, offs = text_bytes(column)
    at, n = 0, len(offs) - 1
    while at < n:
        to = min(n, at + rows, max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1))
        yield at, to, data[offs[at]:offs[to]], offs[at:to + 1] - offs[at]
        at = to


def word_bounds(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray):
    """Starts and ends of the words, and the first word of each text (n + 1 numbers)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    w = is_word[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    starts = w.copy()
    starts[1:] &= ~w[:-1] | cut[1:-1]
    ends = w.copy()
    ends[:-1] &= ~w[1:] | cut[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    size = np.minimum(ends - starts, _LONG_WORD + 1).astype(np.uint8)
    order = np.argsort(_LONG_WORD + 1 - size, kind="stable")
    s, h = starts[order], np.full(len(starts), 0x9E3779B97F4A7C15, np.uint64)
    left = np.cumsum(np.bincount(size, minlength=_LONG_WORD + 2)[::-1])[::-1]
    for j in range(int(size.max()) if len(size) else 0):
        k = int(left[j + 1])
        h[:k] = (h[:k] ^ BYTE_KEYS[data[s[:k] + j]]) * U64(0x9FB21C651E98DF25)
        h[:k] ^= h[:k] >> U64(29)
    out = np.empty_like(h)
    out[order] = h
    for i in np.flatnonzero(size > _LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]].tobytes(), seed=7)
    return mix(out)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive words (len - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += words[j:j + n] * WORD_KEYS[j % 64]
        if j % 64 == 63:
            h = mix(h)
    return mix(h)


class Lookup:
    """Places of 64-bit hashes in a sorted list of different ones, by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.shift = U64(64 - max(4, int(len(keys)).bit_length() + 1))
        self.start = np.searchsorted(self.keys, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift).astype(np.int32)
        self.start = np.append(self.start, np.int32(len(keys)))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Of each hash: its place, or -1."""
        top = (h >> self.shift).astype(np.int64)
        at, end = self.start[top].astype(np.int64), self.start[top + 1]
        out = np.full(len(h), -1, np.int64)
        rest = np.flatnonzero(at < end)
        while len(rest):
            same = self.keys[at[rest]] == h[rest]
            out[rest[same]] = at[rest[same]]
            rest = rest[~same]
            at[rest] += 1
            rest = rest[at[rest] < end[rest]]
        return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def unsigned(h) -> np.ndarray:
    return np.asarray(h, dtype=np.int64).view(np.uint64)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
