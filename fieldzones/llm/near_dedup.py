"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is the sequence of its runs of ``SHINGLE`` words (``[^\\x20\\x09-\\x0D]+``; a shorter text is
one run), each labelled with how often it occurred before, so repeats differ.  For each of
``SKETCHES`` hash functions the ``MINIMA`` least labelled runs are taken and kept in text order:
the hash of that short sequence is a bucket key.  Two texts agree in it with about the chance
J^MINIMA (J: shared runs), and not if shared runs are in another order, which follows the edit
similarity.  All keys miss a pair with a chance of 0.1 % at J = 0.5, which an edit similarity of 0.9
still has, and of 1 in 10^10 at J = 0.8 (of 3 in 10^6 for the finer keys below).

Equal texts are one node (MD5).  First, of each component in a bucket the member of least doc_id is
compared with that of the largest component, for a few hash functions after the other, so that a
large group of near copies is one component before most of its buckets are looked at.  This only
joins components early.  Then, of every bucket of either kind (of ``MINIMA`` and of ``FINER`` minima)
that still holds several components, all members are compared with all those of its other
components: every pair of a bucket is in one component or compared.  Similar texts differ by a
factor of 1.25 in length at most, so members are compared within a class of such lengths and with
the class below; a class is dealt into blocks of about ``BLOCK`` members or ``BLOCK_WORDS`` words, and
each two blocks meet in a task with their words once.  No pair is written, shuffled or joined there.

A pair is linked if its word edit distance is at most 0.2 of the longer text.  It is computed
exactly (on 32 bits of word hashes), in bands that widen as long as needed, many pairs at a time;
pairs whose lengths, bits of their words, or shared runs of three words rule that distance out
(each an exact bound) are not aligned, nor are those that links found before have joined.  Classes
are the components of the links (alternating large-star and small-star rounds over the components
found so far).  A group of m texts that share buckets and are not similar takes m^2 / 2 bounds.

Null text counts as empty, and all texts without a word that are equal are one class.  Texts of
fewer than five words only match equal word sequences.  Repeated rows are one class.  An empty
table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldzones.llm import base
from fieldzones.llm.registry import register
from fieldzones.session import dealt

SHINGLE, SKETCHES, MINIMA, FINER, SIMILARITY = 5, 24, 2, 4, 0.8
_rng = np.random.default_rng(77)
_FLIP, _ODD = _rng.integers(0, 1 << 63, 64, dtype=np.uint64), _rng.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_CELLS, _PADDED = 1 << 15, 1 << 20  # of one band and row, and of padded sequences
BITS = 1024
#: Bands whose buckets are linked by stars, one group after the other.
STARS = ((0, 3), (3, 8), (8, SKETCHES))
#: Members of one block of a bucket, and their words (a longer text is a block's size by itself).
BLOCK, BLOCK_WORDS = 512, 1 << 20


def word_ids(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, first = base.word_bounds(data, offs, base.SPACE_WORD)
    return base.word_hashes(data, s, e), first


def labelled_runs(words: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words with their occurrence label, and each text's first run."""
    sizes = np.diff(first)
    n_runs = np.where(sizes >= k, sizes - k + 1, (sizes > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(n_runs)])
    runs = np.zeros(start[-1], np.uint64)
    text = np.repeat(np.arange(len(sizes)), n_runs)
    full = sizes[text] >= k
    at = np.arange(len(runs)) - start[text] + first[text]
    grams = base.window_hashes(words, k)
    runs[full] = grams[at[full]]
    for t in np.flatnonzero((sizes > 0) & (sizes < k)):
        runs[start[t]] = base.window_hashes(words[first[t]:first[t + 1]], int(sizes[t]))[0] ^ np.uint64(sizes[t])
    key = base.mix(runs + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0)) if len(s) else np.zeros(0, int)
    label = np.empty(len(s), np.uint64)
    label[order] = (np.arange(len(s)) - begin).astype(np.uint64)
    return base.mix(runs + label * np.uint64(0xC2B2AE3D27D4EB4F)), start


def sketch(runs: np.ndarray, sketches: int = SKETCHES, minima: int = MINIMA, finer: int = FINER) -> np.ndarray:
    """The bucket keys of one text: of the ``minima`` least runs for each hash function, then of
    the ``finer`` least."""
    out = np.zeros((2, sketches), np.uint64)
    step = max(1, min(sketches, (1 << 21) // max(len(runs), 1)))
    for a in range(0, sketches, step):
        b = min(sketches, a + step)
        h = (runs[None, :] ^ _FLIP[a:b, None]) * _ODD[a:b, None]
        at = np.empty((b - a, min(finer, len(runs))), np.int64)
        for j in range(at.shape[1]):
            at[:, j] = h.argmin(axis=1)
            h[np.arange(b - a), at[:, j]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        for row, some in enumerate((minima, finer)):
            places = np.sort(at[:, :some], axis=1)  # text order
            key = np.arange(a, b, dtype=np.uint64)
            for j in range(places.shape[1]):
                key = base.mix(key * np.uint64(0x9FB21C651E98DF25) + runs[places[:, j]])
            out[row, a:b] = key
    return out.ravel()


def sketches(texts: DataFrame) -> DataFrame:
    """text_key, bucket keys (none without a word), number of words and ``BITS`` bits, each set by
    some (word, occurrence) of the text, of every row (text_key, text)."""
    def run(batches):
        for rb in batches:
            keys, n, bits = [], [], []
            for a, to, data, offs in base.pieces(rb.column(1), rows=2048):
                words, first = word_ids(data, offs)
                runs, start = labelled_runs(words, first)
                keys += [base.signed(sketch(runs[start[i]:start[i + 1]])) if start[i + 1] > start[i] else np.zeros(0, np.int64) for i in range(to - a)]
                n.append(np.diff(first))
                single, _ = labelled_runs(words, first, 1)
                has = np.zeros((to - a, BITS), bool)
                has[np.repeat(np.arange(to - a), n[-1]), (single >> np.uint64(40)).astype(np.int64) % BITS] = True
                bits.append(np.packbits(has, axis=1).view(np.int64))
            flat = np.concatenate(bits).ravel() if bits else np.zeros(0, np.int64)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(rb) + 1, dtype=np.int32) * (BITS // 64)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(keys, pa.list_(pa.int64())), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64)), vec], names=["text_key", "keys", "n", "vec"])

    return texts.select("text_key", "text").mapInArrow(run, "text_key binary, keys array<long>, n long, vec array<long>")


# ------------------------------------------------------------------------------- alignment

def distances(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
    """Edit distance of each pair of sequences where it is at most its limit, else limit + 1.
    ``least`` are known lower bounds: narrower bands are not tried."""
    out = limits.astype(np.int64) + 1
    size = np.array([[len(a), len(b)] for a, b in pairs], np.int64).reshape(-1, 2)
    low = np.abs(size[:, 0] - size[:, 1])
    low = low if least is None else np.maximum(low, least)
    todo, t = np.flatnonzero(low <= limits), 8
    while len(todo):
        now = todo[low[todo] <= t]
        now = now[np.argsort(size[now, 0], kind="stable")]
        i = 0
        while i < len(now):
            k = min(len(now), i + max(1, _CELLS // (2 * t + 1)))
            k = max(i + 1, i + int(np.searchsorted(size[now[i:k], 0] * np.arange(1, k - i + 1), _PADDED)))
            rows = now[i:k]
            most = np.minimum(t, limits[rows])
            d = band([pairs[r] for r in rows], size[rows], t, most)
            good = d <= most
            out[rows[good]] = d[good]
            i = k
        todo = todo[(out[todo] > limits[todo]) & (limits[todo] > t)]
        t *= 2
    return out


def band(pairs, size: np.ndarray, t: int, most: np.ndarray) -> np.ndarray:
    """Distances that are at most ``most`` (itself at most ``t``; others come out above), in a band of
    2 t + 1 diagonals.  Pairs are sorted by the length of the first sequence.  Every 16 rows, pairs go
    whose cells all lead to more: the rest of a way costs as much as its diagonals differ, at least."""
    p, width = len(pairs), 2 * t + 1
    n, m = int(size[:, 0].max(initial=0)), int(size.max(initial=0))
    a = np.zeros((n, p), np.uint32)
    b = np.zeros((max(n, m) + width + 1, p), np.uint32)  # what lies outside does not reach a result
    for k, (x, y) in enumerate(pairs):
        a[:len(x), k] = x
        b[t:t + len(y), k] = y
    ramp = np.arange(width, dtype=np.int32)[:, None]
    far = np.int32(1 << 28)
    d = np.broadcast_to(np.where(ramp >= t, ramp - t, far), (width, p)).astype(np.int32)
    out = np.full(p, far, np.int64)
    last = (size[:, 1] - size[:, 0] + t).astype(np.int32)  # the place of a pair's last cell
    left = np.arange(p)  # the pairs in d
    for i in range(n + 1):
        done = int(np.searchsorted(size[left, 0], i, "right"))
        if done:
            out[left[:done]] = d[last[left[:done]], np.arange(done)]
            left, a, b, d = left[done:], a[:, done:], b[:, done:], d[:, done:]
        if i == n or not len(left):
            break
        if i % 16 == 15:
            keep = (d + np.abs(ramp - last[left])).min(axis=0) <= most[left]
            if 4 * keep.sum() <= 3 * len(left):
                left, a, b, d = left[keep], a[:, keep], b[:, keep], d[:, keep]
                if not len(left):
                    break
        # row i + 1: column j of it is at place j - (i + 1) + t
        new = d + (b[i:i + width] != a[i])
        np.minimum(new[:-1], d[1:] + 1, out=new[:-1])
        d = new
        if i + 1 <= t:
            d[:t - i - 1] = far
        d = np.minimum.accumulate(d - ramp, axis=0) + ramp
    return out


def lower_bound(a: np.ndarray, b: np.ndarray, q: int = 3) -> int:
    """A lower bound of the distance: an edit changes at most q of the runs of q words."""
    if len(a) < len(b):
        a, b = b, a
    x, y = base.window_hashes(a, q), np.sort(base.window_hashes(b, q))
    if not len(y):
        return 0
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return max(0, -(-(len(x) - common) // q))


def similar(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(leader, member, linked) of rows (leader, member, leader_words, member_words)."""
    def run(batches):
        for rb in batches:
            seqs = [[np.frombuffer(x, np.uint32) for x in rb.column(c).to_pylist()] for c in (2, 3)]
            linked = np.zeros(len(rb), bool)
            limits = np.array([int((1 - similarity) * max(len(a), len(b)) + 1e-9) for a, b in zip(*seqs)], np.int64)
            least = np.array([lower_bound(a.astype(np.uint64), b.astype(np.uint64)) for a, b in zip(*seqs)], np.int64)
            if len(rb):
                linked = distances(list(zip(*seqs)), limits, least) <= limits
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(linked)], names=["leader", "member", "linked"])

    return rows.mapInArrow(run, "leader long, member long, linked boolean")


def sequences(texts: DataFrame) -> DataFrame:
    """(node, keys, words) with 32 bits of the word hashes of (node, keys, text) as bytes."""
    def run(batches):
        for rb in batches:
            out = []
            for _, _, data, offs in base.pieces(rb.column(2)):
                w, first = word_ids(data, offs)
                w = (w >> np.uint64(32)).astype(np.uint32)
                out += [w[first[i]:first[i + 1]].tobytes() for i in range(len(offs) - 1)]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(out, pa.binary())], names=["node", "keys", "words"])

    return texts.select("node", "keys", "text").mapInArrow(run, "node long, keys array<long>, words binary")


# ------------------------------------------------------------------------------------ links

def plausible(a: str, b: str, similarity: float = SIMILARITY):
    """Can columns ``n`` and ``vec`` of two nodes belong to texts that are similar?  An edit changes
    the length by one, and takes and adds one (word, occurrence) at most."""
    limit = F.floor(F.greatest(F.col(f"{a}n"), F.col(f"{b}n")) * (1 - similarity) + 1e-9)
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.get(F.col(f"{a}vec"), i).bitwiseXOR(F.get(F.col(f"{b}vec"), i))) for i in range(BITS // 64)])
    return (F.abs(F.col(f"{a}n") - F.col(f"{b}n")) <= limit) & (differ <= 2 * limit)


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """(node, root) of the nodes (node, text_key, id, keys, n, vec) that share a bucket with another:
    root is the least node of its component of verified links.  None where no two share one."""
    keyed = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    rank = nodes.select("node", F.struct(F.col("id").isNull().alias("none"), "id", "node").alias("rank"))
    shared = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    crowd = base.stored(keyed.join(shared, ["band", "key"]).join(rank, "node"))
    if crowd.isEmpty():
        return None
    some = crowd.select("node").distinct().join(nodes, "node")
    texts = docs.select(F.col("text_key").alias("key_"), F.col("doc_id").alias("id_"), "text")
    texts = texts.join(some, (F.col("key_") == F.col("text_key")) & F.col("id_").eqNullSafe(F.col("id"))).select("node", "keys", "text")
    words = base.stored(sequences(texts).dropDuplicates(["node"]))  # rows of one id and text
    signs = base.stored(some.select("node", "n", "vec"))

    def named(df: DataFrame, who: str, *columns: str) -> DataFrame:
        return df.select(F.col("node").alias(who), *[F.col(c).alias(f"{who}_{c}") for c in columns])

    def check(pairs: DataFrame) -> DataFrame:
        """The leader's words first: its key may be hot, and members are then dealt evenly."""
        rows = pairs.join(named(words, "leader", "words"), "leader").join(named(words, "member", "words"), "member")
        return base.stored(similar(rows.select("leader", "member", "leader_words", "member_words")))

    def merged(roots: DataFrame, linked: DataFrame) -> DataFrame:
        """The roots after more links: components are found among the roots alone."""
        between = linked.join(named(roots, "leader", "root"), "leader").join(named(roots, "member", "root"), "member")
        joined = components(between.select("leader_root", "member_root")).toDF("root", "to")
        return base.stored(roots.join(joined, "root", "left").select("node", F.coalesce("to", "root").alias("root")))

    roots = signs.select("node", F.col("node").alias("root"))
    asked = None
    for a, b in STARS:  # the first of each component in a bucket against that of the largest
        rows = crowd.where(F.col("band").between(a, b - 1)).join(roots, "node")
        firsts = base.stored(rows.groupBy("band", "key", "root").agg(F.min("rank").alias("rank"), F.count("*").alias("c")))
        tops = firsts.groupBy("band", "key").agg(F.max(F.struct("c", "rank")).alias("top"), F.count("*").alias("roots")).where("roots > 1").select("band", "key", F.col("top.rank.node").alias("leader"))
        pairs = firsts.join(tops, ["band", "key"]).select("leader", F.col("rank.node").alias("member")).where("leader <> member")
        pairs = pairs.select(F.least("leader", "member").alias("leader"), F.greatest("leader", "member").alias("member")).distinct()
        pairs = pairs if asked is None else pairs.join(asked, ["leader", "member"], "left_anti")
        pairs = pairs.join(named(signs, "member", "n", "vec"), "member").join(named(signs, "leader", "n", "vec"), "leader").where(plausible("member_", "leader_"))
        checked = check(pairs.select("leader", "member"))
        asked = checked if asked is None else asked.unionByName(checked)
        roots = merged(roots, checked.where("linked"))
    return merged(roots, base.stored(met(blocks(crowd.join(roots, "node"), signs, words))))


def blocks(rows: DataFrame, signs: DataFrame, words: DataFrame) -> DataFrame:
    """Rows (band, key, zone, p, q, at, node, root, keys, words) of every two blocks that meet, from
    (node, band, key, root).  ``zone`` is a class of lengths; its own blocks are numbered first, then
    those of the class below, which visit it.  Blocks p <= q meet, p an own one; ``at`` is the row's."""
    ratio = float(np.log(1 / SIMILARITY + 1e-7))  # similar texts are at most one class apart
    zone = F.floor(F.log("n") / ratio).cast("int")
    rows = rows.select("node", "band", "key", "root").join(signs.select("node", "n"), "node").withColumn("own", zone)
    rows = rows.withColumn("zone", F.explode(F.array(F.col("own"), F.col("own") + 1))).withColumn("own", F.col("own") == F.col("zone"))

    def parts(own: Column) -> Column:
        return F.greatest(F.ceil(F.count(F.when(own, 1)) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)) / BLOCK_WORDS)).cast("int")

    mixed = rows.groupBy("band", "key", "zone").agg(F.min("root").alias("a"), F.max("root").alias("z"), parts(F.col("own")).alias("owns"), parts(~F.col("own")).alias("visits"))
    mixed = mixed.where("a < z and owns > 0").select("band", "key", "zone", "owns", "visits")
    rows = rows.join(mixed, ["band", "key", "zone"])
    deal = F.xxhash64("node")
    rows = rows.withColumn("at", F.when(F.col("own"), F.pmod(deal, F.col("owns"))).otherwise(F.col("owns") + F.pmod(deal, F.greatest("visits", F.lit(1)))).cast("int"))
    last = F.when(F.col("own"), F.col("owns") + F.col("visits")).otherwise(F.col("owns")) - 1
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("band", "key", "zone", F.least("at", "with").alias("p"), F.greatest("at", "with").alias("q"), "at", "node", "root")
    rows = base.stored(rows.join(words, "node").select("band", "key", "zone", "p", "q", "at", "node", "root", "keys", "words"))
    group = ["band", "key", "zone", "p", "q"]
    return dealt(rows, *group).sortWithinPartitions(*group)


def met(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (leader, member) among the rows of ``blocks``, sorted by the blocks that meet: enough of
    them to join all that are linked.  A task holds the two blocks of a meeting, or a batch of them."""
    def run(batches):
        held = None
        for rb in batches:
            t = pa.Table.from_batches([rb] if held is None else [*held.to_batches(), rb]).combine_chunks()
            first = meetings(t)
            cut = int(first[-1]) if len(first) else 0
            if cut:
                yield compare(t.slice(0, cut), similarity)
            held = t.slice(cut)
        if held is not None and len(held):
            yield compare(held, similarity)

    return rows.mapInArrow(run, "leader long, member long")


def meetings(t: pa.Table) -> np.ndarray:
    """The first row of each meeting of two blocks."""
    new = np.zeros(len(t), bool)
    new[:1] = True
    for c in ("band", "key", "zone", "p", "q"):
        v = t.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def compare(t: pa.Table, similarity: float) -> pa.RecordBatch:
    col = lambda c: t.column(c).to_numpy()
    node, band, at, p, q = col("node"), col("band"), col("at"), col("p"), col("q")
    names, root = np.unique(col("root"), return_inverse=True)
    raw, offs = base.text_bytes(t.column("words"))
    raw, offs = raw.view(np.uint32), offs // 4
    n = np.diff(offs)
    keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
    first = np.append(meetings(t), len(t))
    found = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a > 1 and (root[a:b] != root[a]).any():
            here = np.flatnonzero(at[a:b] == p[a]) + a
            there = here if p[a] == q[a] else np.flatnonzero(at[a:b] == q[a]) + a
            found.append(candidates(here, there, raw, offs, n, root, keys, int(band[a]), similarity))
    i, j = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ())))
    limit = np.floor(np.maximum(n[i], n[j]) * (1 - similarity) + 1e-9).astype(np.int64)
    out, turn = [], 1
    while len(i):  # a pair or a few of every two components, then of those still apart
        apart = root[i] != root[j]
        i, j, limit = i[apart], j[apart], limit[apart]
        code = np.minimum(root[i], root[j]) * len(names) + np.maximum(root[i], root[j])
        order = np.argsort(code, kind="stable")
        s = code[order]
        nth = np.arange(len(s)) - np.searchsorted(s, s)
        now, later = order[nth < turn], order[nth >= turn]
        pairs = [(raw[offs[x]:offs[x + 1]], raw[offs[y]:offs[y + 1]]) for x, y in zip(i[now], j[now])]
        least = np.array([lower_bound(x.astype(np.uint64), y.astype(np.uint64)) for x, y in pairs], np.int64)
        for k in now[distances(pairs, limit[now], least) <= limit[now]]:
            x, y = root[i[k]], root[j[k]]
            if x != y:
                out.append((node[i[k]], node[j[k]]))
                root[root == max(x, y)] = min(x, y)
        i, j, limit = i[later], j[later], limit[later]
        turn *= 4
    return pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in out], pa.int64()) for k in (0, 1)], names=["leader", "member"])


def candidates(here, there, raw, offs, n, root, keys, band: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (here, there; each once where both are one block) of different roots that may be
    similar and share no bucket of an earlier band, where they meet as well.  An edit changes the
    length by one, and takes and adds q (run of q words, occurrence) at most."""
    limit = np.floor(np.maximum(n[here][:, None], n[there][None]) * (1 - similarity) + 1e-9)
    may = (root[here][:, None] != root[there][None]) & (np.abs(n[here][:, None] - n[there][None]) <= limit)
    if here is there:
        may &= here[:, None] < there[None]
    x, y = np.nonzero(may)
    limit = limit[x, y]
    if len(x) > 64:  # fewer are as soon bounded one by one
        rows = here if here is there else np.concatenate([here, there])
        first = np.concatenate([[0], np.cumsum(n[rows])])
        words = base.mix(np.concatenate([raw[offs[r]:offs[r + 1]] for r in rows]).astype(np.uint64))
        width = 1 << int(np.clip(4 * n[rows].max(), 256, 8192) - 1).bit_length()
        for k in (1, 2):
            runs, start = labelled_runs(words, first, k)
            has = np.zeros((len(rows), width), np.float32)
            has[np.repeat(np.arange(len(rows)), np.diff(start)), (runs >> np.uint64(40)).astype(np.int64) % width] = 1
            a, b = has[:len(here)], has[-len(there):]
            differ = a.sum(axis=1)[:, None] + b.sum(axis=1)[None] - 2 * (a @ b.T)
            good = differ[x, y] <= 2 * k * limit
            x, y, limit = x[good], y[good], limit[good]
    i, j = here[x], there[y]
    for k in range(0, band):
        good = keys[i, k] != keys[j, k]
        i, j = i[good], j[good]
    return i, j


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v): root is the least node of its component.
    A round shortens paths; one more than needed finds that nothing changes."""
    size = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 32))).first())
    edges = base.stored(edges.toDF("u", "v").where("u <> v").distinct())
    was = size(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = base.stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        edges = base.stored(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        now = size(edges)
        if now == was:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = now


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def classes(docs: DataFrame) -> DataFrame:
    """Of each different text of ``docs`` (doc_id, text, text_key): text_key, the least doc_id
    ``id``, how many rows have both, and the class by the id and key of its first text."""
    ids = docs.groupBy("text_key", "doc_id").agg(F.count("*").alias("times"))
    firsts = ids.groupBy("text_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "times")).alias("f")).select("text_key", "f.id", "f.times")
    keys = sketches(docs).groupBy("text_key").agg(*[F.first(c).alias(c) for c in ("keys", "n", "vec")])
    nodes = base.stored(firsts.join(keys, "text_key").withColumn("node", F.monotonically_increasing_id()))
    roots = links(docs, nodes)
    found = nodes.select("node", "text_key", "id", "times")
    found = found.withColumn("root", F.col("node")) if roots is None else found.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("text_key"))).alias("c")
    reps = found.groupBy("root").agg(first).select("root", F.col("c.id").alias("class_id"), F.col("c.text_key").alias("class_key"))
    return base.stored(found.join(reps, "root").select("text_key", "id", "times", "class_id", "class_key"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class, that of least doc_id, with its columns."""
    base.prepare(spark)
    texts = classes(docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key")))
    first = texts.where(F.col("text_key") == F.col("class_key")).select(F.col("text_key").alias("_llm_key"), F.col("id").alias("_llm_id"), F.col("times").alias("_llm_times"))
    own = docs.withColumn("_llm_own", text_key(F.col("text")))
    rows = own.join(first, (F.col("_llm_own") == F.col("_llm_key")) & F.col("doc_id").eqNullSafe(F.col("_llm_id")))
    if not first.where("_llm_times > 1").isEmpty():  # rows of one id and text: one of them
        number = F.row_number().over(Window.partitionBy("_llm_key", "_llm_id").orderBy("_llm_key"))
        rows = rows.withColumn("_llm_times", number).where("_llm_times = 1")
    return rows.select(*docs.columns)


@register("op6_order_minhash")
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    found = classes(docs).select("text_key", "class_id")
    return docs.select("doc_id", "text_key").join(found, "text_key").select(
        "doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
