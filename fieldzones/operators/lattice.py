"""Variogram and ordinary kriging of whole grids (M9, M10): data on a square lattice.

The points of a field's grid (10 m apart) are kept as blocks of ``BLOCK`` x ``BLOCK`` lattice cells, one
row per (field, variable, block) with the values as packed doubles.  On a lattice the covariance of
two nodes depends on their offset only, so there is no edge table: a covariance stencil is
built from the model where it is used.

* ``lattice_variogram`` (M9): all pairs of a (field, variable).  The sums over the pairs of two sheets of
  blocks by offset are correlations (FFT), added up by lag.
* ``fit_weighted`` (M9): spherical model by least squares weighted with the number of pairs, for a
  grid of ranges, in closed form.
* ``solve_lattice`` (M10): C u = z and C v = 1 for all groups together by preconditioned conjugate gradients.  Each
  round is one shuffle: a block's residual goes to the blocks within reach, where the preconditioner
  and the stencil are applied; the sums over a group's blocks are a partial aggregate.  The
  preconditioner is a sparse factor of the inverse: for every node the best coefficients over the
  nodes up to ``NEAR`` cells before it, solved once for each pattern of nodes that are there.
* ``krige_lattice`` (M10): mean + m + sum of b C at the centre of every cell, b = u - m v, m = sum(u) / sum(v).

Lattices of at most ``LOCAL_CELLS`` cells (the range may be longer than the field, every block then meets
every other) are solved, kriged and checked in one task each, of bounded memory; where the nugget outweighs what
is near a node, with ``Smooth`` as the preconditioner.  Of larger ones a task holds a block with
the cells within reach (range + 2 * NEAR cells) around it, and the state is a stored table, so a
lost executor costs one round at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldzones.session import BROADCAST_MAX_BYTES, cut_lineage, dealt, join_small, parallelism, stored_bytes

BLOCK, NEAR = 64, 4
N_RANGES = 200
#: Blocks of a sheet of the variogram; cells of a lattice that is solved in one task, with their rounds.
SHEET, LOCAL_CELLS, LOCAL_ROUNDS = 384, 1 << 21, 1000
#: Blocks of a lattice whose points are packed by one task.
DEALT = 32
#: Partitions to a core for groups that are solved in one task each.
APART = 16
#: Places of the coarse lattice of ``Smooth``, and the spread of eigenvalues up to which it is used.
COARSE, SPREAD = 1024, 30.0
#: Rows whose sums are made directly (``by_offsets``), and the numbers of a matrix there.
LEAST, DIRECT = 64, 1 << 21
_CELLS = BLOCK * BLOCK


def _apart(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` by ``keys`` in many more partitions than cores: a group is long work, and two in one task wait for each other."""
    spark = df.sparkSession
    return df.repartition(max(APART * parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


# ------------------------------------------------------------------------------ blocks

def lattice_blocks(points: DataFrame, cell: float = 10.0, keys=("codigo", "variable"), extent: DataFrame | None = None) -> DataFrame:
    """Blocks of ``points`` (keys, x, y, value): keys, x0, y0, nx, ny (lattice), bx, by, mask, value.

    ``extent`` (codigo, xmin, ymin, xmax, ymax) widens the lattice of a field beyond its points.  Null values
    are left out, several values of one node are averaged; a point off the lattice is an error."""
    keys = list(keys)
    pts = points.filter(F.col("value").isNotNull()).select(*keys, "x", "y", "value")
    if extent is None:
        own = pts.groupBy(keys[0]).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    else:
        own = extent.select(keys[0], F.col("xmin").alias("x0"), F.col("ymin").alias("y0"), F.col("xmax").alias("x1"), F.col("ymax").alias("y1"))
    steps = lambda a, b: F.round((F.col(b) - F.col(a)) / cell).cast("int")
    own = cut_lineage(own.select(keys[0], "x0", "y0", (steps("x0", "x1") + 1).alias("nx"), (steps("y0", "y1") + 1).alias("ny")))
    pts = join_small(pts, own, keys[0]).withColumns({"i": steps("x0", "x"), "j": steps("y0", "y")})
    off = (F.abs(F.col("x") - F.col("x0") - F.col("i") * cell) > 1e-6 * cell) | (F.abs(F.col("y") - F.col("y0") - F.col("j") * cell) > 1e-6 * cell)
    at = F.when(off, F.raise_error(F.lit("point off the lattice")).cast("int")).otherwise(F.pmod("j", F.lit(BLOCK)) * BLOCK + F.pmod("i", F.lit(BLOCK)))
    rows = pts.select(*keys, F.floor(F.col("i") / BLOCK).cast("int").alias("bx"), F.floor(F.col("j") / BLOCK).cast("int").alias("by"), at.cast("int").alias("at"), F.col("value").cast("double").alias("value"))
    # few blocks to a partition: lists are made once, after the only shuffle, and go to Python in small batches
    spark, wide = points.sparkSession, lambda n: F.ceil(F.col(n) / BLOCK)
    many = own.agg(F.sum(wide("nx") * wide("ny"))).first()[0] or 0
    n = max(parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(many) // DEALT))
    rows = rows.repartition(n, keys[0], "bx", "by").groupBy(*keys, "bx", "by").agg(F.collect_list(F.struct("at", "value")).alias("v"))
    rows = join_small(rows, own, keys[0]).select(*keys, "x0", "y0", "nx", "ny", "bx", "by", F.col("v.at").alias("at"), F.col("v.value").alias("value"))
    carried = rows.columns[:-2]

    def dense(batches):
        for rb in batches:
            masks, values = [], []
            for k in range(len(rb)):
                place, value = (rb.column(c)[k].values.to_numpy() for c in (len(carried), len(carried) + 1))
                count = np.bincount(place, minlength=_CELLS)
                masks.append((count > 0).tobytes())
                values.append((np.bincount(place, value, _CELLS) / np.maximum(count, 1)).tobytes())
            yield pa.RecordBatch.from_arrays([*[rb.column(c) for c in range(len(carried))], pa.array(masks, pa.binary()), pa.array(values, pa.binary())], names=[*carried, "mask", "value"])

    kinds = dict(rows.dtypes)
    return cut_lineage(rows.mapInArrow(dense, ", ".join(f"{c} {kinds[c]}" for c in carried) + ", mask binary, value binary"))


def _grid(packed: bytes, kind=np.float64, layers: int = 1) -> np.ndarray:
    a = np.frombuffer(packed, kind).reshape(layers, BLOCK, BLOCK)
    return a if layers > 1 else a[0]


# --------------------------------------------------------------------------- variogram

def lattice_variogram(blocks: DataFrame, n_lags: int = 6, cell: float = 10.0, keys=("codigo", "variable"),
                      max_dist: float | None = None) -> DataFrame:
    """M9: semivariogram over all pairs of each group (up to ``max_dist`` apart, if given), in ``n_lags``
    equal lags from the least to the greatest distance: keys, lag_bin, lag, gamma, n_pairs.

    Neighbouring blocks of a group are put together into sheets of at most ``SHEET`` blocks; pairs of sheets stand
    for pairs of points.  The distances of a group are found first (from the masks alone), so that a pair
    of sheets gives a row for each lag."""
    keys = list(keys)
    kinds = dict(blocks.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    wide = lambda n: F.floor((F.col(n) - 1) / BLOCK) + 1
    sheets = blocks.withColumn("across", F.least(wide("nx"), F.lit(SHEET))).withColumn("down", F.greatest(F.lit(1), F.floor(F.lit(SHEET) / F.col("across"))))
    many = lambda n, by: F.floor((wide(n) - 1) / F.col(by)) + 1
    sheets = sheets.withColumns({"sx": F.floor(F.col("bx") / F.col("across")), "sy": F.floor(F.col("by") / F.col("down")), "columns": many("nx", "across"), "lines": many("ny", "down")})
    sheets = sheets.select(*keys, "bx", "by", "mask", "value", (F.col("sy") * F.col("columns") + F.col("sx")).cast("int").alias("sheet"), (F.col("lines") * F.col("columns")).cast("int").alias("sheets"))

    def together(t: pa.Table) -> pa.Table:
        """The nodes of a sheet: its first node, its size, the mask and the values."""
        bx, by = (t[c].to_numpy() for c in ("bx", "by"))
        x0, y0 = int(bx.min()), int(by.min())
        shape = (int(by.max()) - y0 + 1) * BLOCK, (int(bx.max()) - x0 + 1) * BLOCK
        mask, value = np.zeros(shape, bool), np.zeros(shape)
        for m, v, i, j in zip(t["mask"], t["value"], (bx - x0).tolist(), (by - y0).tolist()):
            at = slice(j * BLOCK, (j + 1) * BLOCK), slice(i * BLOCK, (i + 1) * BLOCK)
            mask[at], value[at] = _grid(m.as_py(), bool), _grid(v.as_py())
        y, x = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
        box = slice(y[0], y[-1] + 1), slice(x[0], x[-1] + 1)
        held = mask[box]
        packed = [np.packbits(held).tobytes(), value[box][held].tobytes()]
        place = [x0 * BLOCK + int(x[0]), y0 * BLOCK + int(y[0]), held.shape[1], held.shape[0]]
        return pa.table([t[k].slice(0, 1) for k in keys] + [t[c].slice(0, 1) for c in ("sheet", "sheets")] + [pa.array([p], pa.int32()) for p in place] + [pa.array([p], pa.binary()) for p in packed],
                        names=[*keys, "sheet", "sheets", "x", "y", "w", "h", "mask", "value"])

    made = cut_lineage(dealt(sheets, *keys, "sheet").groupBy(*keys, "sheet").applyInArrow(together, head + ", sheet int, sheets int, x int, y int, w int, h int, mask binary, value binary"))
    sent = made.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sheets") - 1)))
    sent = sent.withColumns({"first": F.least("sheet", "other"), "second": F.greatest("sheet", "other")}).drop("other", "sheets")
    pair = [*keys, "first", "second"]

    def spectra(t: pa.Table):
        """The two sheets of a pair: size of the transforms, masks, and the distances of the offsets."""
        sides = []
        for k in np.argsort(t["sheet"].to_numpy()):
            r = {c: t[c][int(k)].as_py() for c in ("x", "y", "w", "h", "mask")}
            r["mask"] = np.unpackbits(np.frombuffer(r["mask"], np.uint8), count=r["w"] * r["h"]).reshape(r["h"], r["w"]).astype(bool)
            sides.append((r, int(k)))
        one, two = sides[0], sides[-1]
        if len(sides) < 2 and t["first"][0].as_py() != t["second"][0].as_py():
            return None  # the other sheet has no nodes
        size = _fast(one[0]["h"] + two[0]["h"] - 1), _fast(one[0]["w"] + two[0]["w"] - 1)
        f1, f2 = (np.fft.rfft2(s[0]["mask"].astype(float), size) for s in (one, two))
        n = np.rint(np.fft.irfft2(f1.conj() * f2, size)).astype(np.int64)
        steps = []
        for axis, (at, length) in enumerate((("y", "h"), ("x", "w"))):
            k = np.arange(size[axis])
            steps.append(np.where(k >= two[0][length], k - size[axis], k) + two[0][at] - one[0][at])
        dy, dx = steps[0][:, None], steps[1][None, :]
        used = n > 0
        if len(sides) < 2:
            used &= (dy > 0) | ((dy == 0) & (dx > 0))  # each pair once
        d = np.sqrt((dx ** 2 + dy ** 2)[used] * (cell * cell))
        if max_dist is not None:
            near = d <= max_dist
            used[used] = near
            d = d[near]
        return one, two, size, (f1, f2), n, used, d

    def span(t: pa.Table) -> pa.Table:
        got = spectra(t)
        ends = [] if got is None or not len(got[-1]) else [[float(got[-1].min())], [float(got[-1].max())]]
        rows = [t[k].slice(0, 1 if ends else 0) for k in keys]
        return pa.table(rows + [pa.array(e, pa.float64()) for e in ends or [[], []]], names=[*keys, "least", "most"])

    def sums(t: pa.Table) -> pa.Table:
        got, names = spectra(t), [*keys, "lag_bin", "n", "dn", "sq"]
        rows = []
        if got is not None and len(got[-1]):
            one, two, size, f, n, used, d = got
            least, most = t["least"][0].as_py(), t["most"][0].as_py()
            z = []
            for r, k in (one, two):
                grid = np.zeros(r["mask"].shape)
                grid[r["mask"]] = np.frombuffer(t["value"][k].as_py())
                z.append(grid)
            level = z[0][one[0]["mask"]].mean()  # differences do not change, rounding does
            z = [(a - level) * s[0]["mask"] for a, s in zip(z, (one, two))]
            q1, q2 = (np.fft.rfft2(a * a, size) for a in z)
            total = q1.conj() * f[1] + f[0].conj() * q2
            del q1, q2
            total -= 2 * np.fft.rfft2(z[0], size).conj() * np.fft.rfft2(z[1], size)
            sq = np.maximum(np.fft.irfft2(total, size)[used], 0.0)
            width = (most - least) / n_lags
            at = np.minimum(np.floor((d - least) / width).astype(np.int64), n_lags - 1) if width > 0 else np.zeros(len(d), np.int64)
            count = n[used]
            rows = [(b, c, e, s) for b, (c, e, s) in enumerate(zip(*(np.bincount(at, w, n_lags) for w in (count, d * count, sq)))) if c > 0]
        return pa.table([pa.array([t[k][0].as_py()] * len(rows), t.schema.field(k).type) for k in keys] + [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.float64(), pa.float64(), pa.float64()))], names=names)

    paired = lambda df: dealt(df, *pair).groupBy(*pair)
    ends = paired(sent.drop("value")).applyInArrow(span, head + ", least double, most double").groupBy(*keys).agg(F.min("least").alias("least"), F.max("most").alias("most"))
    found = paired(join_small(sent, ends, keys)).applyInArrow(sums, head + ", lag_bin int, n double, dn double, sq double")
    return found.groupBy(*keys, "lag_bin").agg((F.sum("dn") / F.sum("n")).alias("lag"), (F.sum("sq") / (2 * F.sum("n"))).alias("gamma"), F.sum("n").cast("long").alias("n_pairs"))


def fit_weighted(bins: DataFrame, keys=("codigo", "variable"), n_ranges: int = N_RANGES) -> DataFrame:
    """M9: spherical model by least squares weighted with ``n_pairs``: keys, nugget, psill, range, sse.

    The range is one of ``n_ranges`` from half the first lag to three times the last; nugget and partial
    sill are the weighted line through (shape, gamma), kept non-negative.  Equal sums: least range."""
    keys = list(keys)
    ends = bins.groupBy(*keys).agg(F.min("lag").alias("first"), F.max("lag").alias("last"))
    tried = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_ranges - 1)))).withColumn(
        "range", F.col("first") * 0.5 + F.col("k") * ((F.col("last") * 3.0 - F.col("first") * 0.5) / (n_ranges - 1.0)))
    t = F.col("lag") / F.col("range")
    rows = bins.select(*keys, "lag", "gamma", F.col("n_pairs").cast("double").alias("w")).join(tried.select(*keys, "k", "range"), keys)
    rows = rows.withColumn("s", F.when(F.col("lag") < F.col("range"), 1.5 * t - 0.5 * t * t * t).otherwise(1.0))
    sums = rows.groupBy(*keys, "k", "range").agg(*[F.sum(F.expr(f"w * {e}")).alias(n) for n, e in (
        ("w", "1"), ("ws", "s"), ("wg", "gamma"), ("wss", "s * s"), ("wsg", "s * gamma"), ("wgg", "gamma * gamma"))])
    det = F.expr("w * wss - ws * ws")
    slope = F.when(det > 1e-9 * F.col("w") * F.col("wss"), F.expr("(w * wsg - ws * wg)") / det).otherwise(0.0)
    sums = sums.withColumn("b", slope).withColumn("a", F.expr("(wg - b * ws) / w"))
    fit = sums.withColumns({"nugget": F.expr("CASE WHEN b < 0 THEN greatest(wg / w, 0.0D) WHEN a < 0 THEN 0.0D ELSE a END"),
                            "psill": F.expr("CASE WHEN b < 0 THEN 0.0D WHEN a < 0 THEN greatest(wsg / wss, 0.0D) ELSE b END")})
    sse = F.expr("wgg - 2 * nugget * wg - 2 * psill * wsg + nugget * nugget * w + 2 * nugget * psill * ws + psill * psill * wss")
    best = fit.withColumn("sse", sse).groupBy(*keys).agg(F.min_by(F.struct("nugget", "psill", "range", "sse"), F.struct(F.round(F.col("sse") / F.col("wgg"), 9), F.col("k"))).alias("f"))
    return best.select(*keys, "f.nugget", "f.psill", "f.range", "f.sse")


# ------------------------------------------------------------------------ stencils

def _near():
    """Offsets of the nodes up to NEAR cells before a node (row by row), itself last."""
    o = [(dy, dx) for dy in range(-NEAR, 1) for dx in range(-NEAR, NEAR + 1) if (dy, dx) <= (0, 0) and dx * dx + dy * dy <= NEAR * NEAR]
    return np.array(sorted(o))


def _fast(n: int) -> int:
    """The least length from ``n`` on without prime factors over 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


class Stencil:
    """Covariances of one model by lattice offset, as far as its range and the lattice (nx, ny) reach."""

    def __init__(self, g: dict, cell: float):
        self.psill, self.c0, self.range, self.cell = g["psill"], g["c0"], g["range"], cell
        reach = int(np.ceil(self.range / cell)) if self.psill > 0 else 0
        self.ry, self.rx = min(reach, g["ny"]), min(reach, g["nx"])

    def at(self, dx, dy):
        h = np.sqrt(dx * dx + dy * dy) * (self.cell / self.range)
        return np.where((dx == 0) & (dy == 0), self.c0, np.where(h < 1, self.psill * (1.0 - 1.5 * h + 0.5 * h * h * h), 0.0))

    def kernel(self, shift: float = 0.0) -> np.ndarray:
        """Covariances at the offsets up to one cell over the reach, moved by ``shift`` cells."""
        y, x = (np.arange(-r - 1, r + 2) + shift for r in (self.ry, self.rx))
        return self.at(x[None, :], y[:, None])

    def convolve(self, a: np.ndarray, shift: float = 0.0) -> np.ndarray:
        """Sums of ``a`` (layers, rows, columns) times the covariance, where all nodes within reach are in ``a``."""
        k = self.kernel(shift)
        size = tuple(map(_fast, a.shape[1:]))
        f = np.fft.rfft2(a, size) * np.fft.rfft2(k, size)
        return np.fft.irfft2(f, size)[:, 2 * self.ry + 2:a.shape[1], 2 * self.rx + 2:a.shape[2]]

    def whole(self, shape: tuple[int, int], shift: float = 0.0):
        """The function that sums a whole lattice of ``shape`` (layers, rows, columns) times the covariance."""
        k = self.kernel(shift)
        size = tuple(_fast(max(n + r + 2, m)) for n, r, m in zip(shape, (self.ry, self.rx), k.shape))
        f = np.fft.fft(np.fft.rfft(k.T, size[0]), size[1], axis=0)
        ry, rx = self.ry + 1, self.rx + 1

        def summed(a: np.ndarray) -> np.ndarray:
            out = np.empty((len(a), *shape))
            for layer, total in zip(a, out):  # one at a time: the transforms are the most that a task holds
                t = np.fft.fft(np.fft.rfft(layer.T, size[0]), size[1], axis=0)
                t *= f
                t = np.fft.ifft(t, axis=0)[rx:rx + shape[1]]  # only the columns that are wanted go back
                total[:] = np.fft.irfft(t, size[0])[:, ry:ry + shape[0]].T
            return out

        return summed

    def by_offsets(self, u: np.ndarray) -> np.ndarray:
        """Sums of a whole lattice ``u`` (rows, columns) times the covariance without a transform, for each distance of
        two rows all offsets along them as one matrix.  Where many rows are in reach, halves of the rows share products."""
        if u.shape[1] > u.shape[0]:
            return self.by_offsets_of(u.T, self.rx).T
        return self.by_offsets_of(u, self.ry)

    def by_offsets_of(self, u: np.ndarray, reach: int) -> np.ndarray:
        n, across = u.shape
        least = max(1, min(LEAST, DIRECT // max(1, across * across)))
        out = np.zeros(u.shape)
        if min(reach, n - 1) <= 4 * least:
            along = np.arange(across)
            steps = (along[:, None] - along[None, :]).astype(float)
            for dy in range(min(reach, n - 1) + 1):
                c = self.at(steps, np.float64(dy))
                out[:n - dy] += u[dy:] @ c
                if dy:
                    out[dy:] += u[:n - dy] @ c
            return out
        strip, wide = n if 3 * (reach + 1) >= n else reach + 1, across + across % 2
        size = strip
        while size > least:
            size = -(-size // 2)
        while size < strip:
            size *= 2
        for b in range(0, n, strip):
            sent = np.zeros((size, wide))
            sent[:len(u[b:b + strip]), :across] = u[b:b + strip]
            for a in (b - strip, b, b + strip):
                if 0 <= a < n:
                    k = self.at(np.arange(wide)[None, :], np.arange(a - b - size + 1, a - b + size)[:, None])
                    out[a:a + strip] += _shared(k, sent, least)[:len(out[a:a + strip]), :across]
        return out

    def factor(self, mask: np.ndarray):
        """Coefficients of each node over the nodes before it: a row for each pattern, and each node's pattern.

        ``mask`` has a margin of NEAR cells around the nodes that are asked for."""
        o = _near()
        inner = tuple(n - 2 * NEAR for n in mask.shape)
        bits = np.zeros(inner, np.int64)
        for k, (dy, dx) in enumerate(o):
            bits |= mask[NEAR + dy:NEAR + dy + inner[0], NEAR + dx:NEAR + dx + inner[1]].astype(np.int64) << k
        bits[~mask[NEAR:-NEAR, NEAR:-NEAR]] = 0
        kinds, of = np.unique(bits, return_inverse=True)
        c = self.at(o[:, None, 1] - o[None, :, 1], o[:, None, 0] - o[None, :, 0])
        rows = []
        for part in np.array_split(kinds, -(-len(kinds) // _CELLS)):
            there = (part[:, None] >> np.arange(len(o))) & 1 > 0
            unit = np.zeros((len(part), len(o), 1))
            unit[:, -1] = 1.0
            g = np.linalg.solve(np.where(there[:, :, None] & there[:, None, :], c, np.eye(len(o))), unit)[:, :, 0]
            rows.append(g / np.sqrt(g[:, -1:]) * there)
        return np.concatenate(rows), of.reshape(inner)

    def precondition(self, r: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """G' G r for the nodes with a margin of 2 * NEAR cells inside ``r`` (layers, rows, columns)."""
        m = 2 * NEAR
        out = np.zeros((r.shape[0], r.shape[1] - 2 * m, r.shape[2] - 2 * m))
        y, x = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
        if len(y):  # only where nodes are
            box = slice(y[0], y[-1] + 1), slice(x[0], x[-1] + 1)
            found = self._within(np.pad(r[:, box[0], box[1]], ((0, 0), (m, m), (m, m))), np.pad(mask[box], m))
            whole = np.zeros(r.shape)
            whole[:, box[0], box[1]] = found
            out = whole[:, m:-m, m:-m]
        return out

    def _within(self, r: np.ndarray, mask: np.ndarray, factor=None) -> np.ndarray:
        g, of = self.factor(mask) if factor is None else factor
        o, n = _near(), of.shape
        q = np.zeros((r.shape[0], *n))
        for k, (dy, dx) in enumerate(o):
            q += g[of, k] * r[:, NEAR + dy:NEAR + dy + n[0], NEAR + dx:NEAR + dx + n[1]]
        m = tuple(x - 2 * NEAR for x in n)
        out = np.zeros((r.shape[0], *m))
        for k, (dy, dx) in enumerate(o):
            at = slice(NEAR - dy, NEAR - dy + m[0]), slice(NEAR - dx, NEAR - dx + m[1])
            out += g[of[at], k] * q[:, at[0], at[1]]
        return out * mask[2 * NEAR:-2 * NEAR, 2 * NEAR:-2 * NEAR]


def _shared(k: np.ndarray, u: np.ndarray, least: int) -> np.ndarray:
    """Row i of the result: the sum over the rows j of ``u`` of u[j] times the covariances ``k`` (2 n - 1 distances of
    rows, distances along them) of i - j.  Three products of halves stand for four, as in Karatsuba's rule."""
    n = len(u)
    if n <= least:
        return _direct(k, u)
    h = n // 2
    middle, before, after = k[h:n + h - 1], k[:n - 1], k[n:]
    both = _shared(middle, u[:h] + u[h:], least)
    return np.concatenate([both + _shared(before - middle, u[h:], least), both + _shared(after - middle, u[:h], least)])


def _direct(k: np.ndarray, u: np.ndarray) -> np.ndarray:
    """``_shared`` offset by offset: the covariances are the same to both sides along a row, so sums and differences
    of its two halves are multiplied apart, by a matrix for each distance of rows."""
    n, half = len(u), u.shape[1] // 2
    i = np.arange(half)
    straight, crossed = (k[::-1][:, at] for at in (np.abs(i[:, None] - i[None, :]), 2 * half - 1 - i[:, None] - i[None, :]))
    parts = []
    for sign in (1, -1):
        v = np.zeros((3 * n - 2, half))
        v[n - 1:2 * n - 1] = u[:, :half] + sign * u[:, :half - 1:-1]
        windows = np.lib.stride_tricks.as_strided(v, (n, (2 * n - 1) * half), (v.strides[0], v.strides[1]))
        parts.append(windows @ (straight + sign * crossed).reshape(-1, half))
    return np.concatenate([parts[0] + parts[1], (parts[0] - parts[1])[:, ::-1]], axis=1) / 2


class Smooth:
    """A preconditioner where the covariance is nugget and a part that changes little from cell to cell, so that the
    nodes near a node say little of it and very many together do: the inverse of delta I + P K P', K the covariance
    of at most ``COARSE`` places spread evenly over the lattice, P the bilinear interpolation between them.

    ``spread`` estimates the quotient of the eigenvalues that it leaves (infinite without a nugget)."""

    def __init__(self, st: Stencil, shape: tuple[int, int]):
        self.st, self.shape, step = st, shape, 1.0
        count = lambda n: int(np.ceil((n - 1) / step)) + 1 if n > step else 1
        while np.prod([count(n) for n in shape]) > COARSE:
            step *= 1.05
        self.many = [count(n) for n in shape]
        self.steps = [(n - 1) / (m - 1) if m > 1 else float(n) for n, m in zip(shape, self.many)]
        nugget, lost = st.c0 - st.psill, st.psill * min(1.0, 0.375 * max(self.steps) * st.cell / st.range)
        self.delta = nugget + lost
        self.spread = 1.0 + lost * self.steps[0] * self.steps[1] / nugget if nugget > 0 and st.psill > 0 else np.inf

    def prepare(self, mask: np.ndarray) -> Smooth:
        self.mask, sides, places = mask, [], []
        for at, n, m, step in zip(np.nonzero(mask), self.shape, self.many, self.steps):
            first = np.minimum((at / step).astype(np.int64), max(m - 2, 0))
            share = at / step - first
            sides.append([(first, 1.0 - share), (first + 1, share)] if m > 1 else [(first, np.ones(len(at)))])
            places.append(np.arange(m) * step if m > 1 else np.array([(n - 1) / 2]))
        self.corners = [(iy * self.many[1] + ix, wy * wx) for iy, wy in sides[0] for ix, wx in sides[1]]
        y, x = (a.ravel() for a in np.meshgrid(*places, indexing="ij"))
        k = self.st.at(x[:, None] - x[None, :], y[:, None] - y[None, :])
        np.fill_diagonal(k, self.st.psill)
        value, vector = np.linalg.eigh(k)
        root = vector * np.sqrt(np.maximum(value, 0.0))
        n = self.n = len(k)
        gram = np.zeros(n * n)
        for a, wa in self.corners:
            for b, wb in self.corners:
                gram += np.bincount(a * n + b, wa * wb, n * n)
        self.core = root @ np.linalg.solve(self.delta * np.eye(n) + root.T @ gram.reshape(n, n) @ root, root.T)
        return self

    def __call__(self, r: np.ndarray) -> np.ndarray:
        """For ``r`` (layers, rows, columns), 0 where ``mask`` has no node."""
        out = np.zeros(r.shape)
        for a, z in zip(r, out):
            held = a[self.mask]
            coarse = self.core @ sum(np.bincount(c, w * held, self.n) for c, w in self.corners)
            z[self.mask] = (held - sum(w * coarse[c] for c, w in self.corners)) / self.delta
        return out


def _mosaic(t: pa.Table, column: str, margin: tuple[int, int], kind=np.float64, layers: int = 1) -> np.ndarray:
    """The block at the middle of a group with ``margin`` cells (rows, columns) around it, from its neighbours' rows."""
    ry, rx = (-(-m // BLOCK) for m in margin)
    out = np.zeros((layers, (2 * ry + 1) * BLOCK, (2 * rx + 1) * BLOCK), kind)
    for packed, ex, ey in zip(t[column], t["ex"].to_pylist(), t["ey"].to_pylist()):
        if abs(ey) <= ry and abs(ex) <= rx and (raw := packed.as_py()) is not None:
            y, x = (ry + ey) * BLOCK, (rx + ex) * BLOCK
            out[:, y:y + BLOCK, x:x + BLOCK] = np.frombuffer(raw, kind).reshape(layers, BLOCK, BLOCK)
    cut_y, cut_x = ry * BLOCK - margin[0], rx * BLOCK - margin[1]
    return out[:, cut_y:out.shape[1] - cut_y, cut_x:out.shape[2] - cut_x]


def _spread(blocks: DataFrame, reach, carried: list[str], own: list[str]) -> DataFrame:
    """Each block for itself and for the blocks of its lattice within ``reach`` cells: ex, ey say where
    it lies from the receiver; the ``own`` columns stay with the block itself."""
    rings = F.ceil(reach / BLOCK).cast("int")
    side = lambda b, n: F.sequence(F.greatest(F.col(b) - rings, F.lit(0)), F.least(F.col(b) + rings, F.floor((F.col(n) - 1) / BLOCK).cast("int")))
    b = blocks.withColumn("tx", F.explode(side("bx", "nx"))).withColumn("ty", F.explode(side("by", "ny")))
    b = b.withColumns({"ex": F.col("bx") - F.col("tx"), "ey": F.col("by") - F.col("ty")})
    mine = (F.col("ex") == 0) & (F.col("ey") == 0)
    return b.select(*carried, F.col("tx").alias("bx"), F.col("ty").alias("by"), "ex", "ey", *[F.when(mine, F.col(c)).alias(c) for c in own])


# -------------------------------------------------------------------------- kriging

_SUMS = [f"{x}{s}" for s in "uv" for x in ("rz", "wz", "rr")]
_OLD = [f"{x}{s}" for s in "uv" for x in ("rz_old", "a_old", "first")]
_STATE = ["r", "x", "p", "s", "z", "w"]


def _advance(values: dict, stop: float):
    """One step of both systems of a block: new r, x, p, s and the two scalars of each."""
    a = {c: _grid(values[c], layers=2).copy() for c in _STATE}
    scalars = []
    for k, side in enumerate("uv"):
        g, d, old_g, old_a = values["sum_rz" + side], values["sum_wz" + side], values["rz_old" + side], values["a_old" + side]
        first = values["first" + side] or values["sum_rr" + side]
        if values["sum_rr" + side] <= stop * stop * first or g <= 0:
            scalars += [g, 0.0, first]  # solved: nothing moves any more
            continue
        beta = g / old_g if old_a else 0.0
        alpha = g / (d - beta * g / old_a) if old_a else g / d
        a["p"][k] = a["z"][k] + beta * a["p"][k]
        a["s"][k] = a["w"][k] + beta * a["s"][k]
        a["x"][k] += alpha * a["p"][k]
        a["r"][k] -= alpha * a["s"][k]
        scalars += [g, alpha, first]
    return a, scalars


def _whole(t: pa.Table, column: str, shape: tuple[int, int], kind=np.float64, layers: int = 1) -> np.ndarray:
    """A group's lattice of ``shape`` from the blocks of ``t``."""
    out = np.zeros((layers, *(-(-n // BLOCK) * BLOCK for n in shape)), kind)
    for packed, bx, by in zip(t[column], t["bx"].to_pylist(), t["by"].to_pylist()):
        out[:, by * BLOCK:(by + 1) * BLOCK, bx * BLOCK:(bx + 1) * BLOCK] = _grid(packed.as_py(), kind, layers)
    return out[:, :shape[0], :shape[1]]


def _solve_whole(base: DataFrame, keys: list[str], fixed: list[str], cell: float, tol: float) -> DataFrame:
    """Both systems of every lattice of at most ``LOCAL_CELLS`` cells, each in one task: the same preconditioned
    conjugate gradients, with the covariance as one transform of the lattice."""
    kinds = dict(base.dtypes)

    def run(t: pa.Table) -> pa.Table:
        g = t.select(["nx", "ny", "mean", "psill", "c0", "range"]).slice(0, 1).to_pylist()[0]
        st, shape, m = Stencil(g, cell), (g["ny"], g["nx"]), 2 * NEAR
        mask = _whole(t, "mask", shape, bool)[0]
        product, around = st.whole(shape), np.pad(mask, m)
        smooth, edge = Smooth(st, shape), ((0, 0), (m, m), (m, m))
        if smooth.spread <= SPREAD:
            near = smooth.prepare(mask)
        else:
            factor = st.factor(around)
            near = lambda r: st._within(np.pad(r, edge), around, factor)
        r = np.stack([(_whole(t, "value", shape)[0] - g["mean"]) * mask, mask.astype(float)])
        x, p = np.zeros(r.shape), np.zeros(r.shape)
        dot = lambda a, b: np.einsum("kij,kij->k", a, b)[:, None, None]
        first, old, done = dot(r, r), None, 0
        while (going := dot(r, r) > tol * tol * first).any():
            if done == LOCAL_ROUNDS:
                raise RuntimeError("kriging systems did not converge")
            z = near(r)
            rz = dot(r, z)
            p = z if old is None else z + np.divide(rz, old, out=np.zeros_like(rz), where=old > 0) * p
            w = product(p) * mask
            pw = dot(p, w)
            alpha = np.divide(rz, pw, out=np.zeros_like(rz), where=going & (pw > 0))
            x += alpha * p
            r -= alpha * w
            old, done = rz, done + 1
        full = np.pad(x, ((0, 0), (0, -shape[0] % BLOCK), (0, -shape[1] % BLOCK)))
        packed = [full[:, by * BLOCK:(by + 1) * BLOCK, bx * BLOCK:(bx + 1) * BLOCK].tobytes() for bx, by in zip(t["bx"].to_pylist(), t["by"].to_pylist())]
        return t.select(fixed).append_column("x", pa.array(packed, pa.binary())).append_column("rounds", pa.array([done] * len(t), pa.int32()))

    schema = ", ".join(f"{c} {kinds[c]}" for c in fixed) + ", x binary, rounds int"
    return cut_lineage(_apart(base, keys).groupBy(*keys).applyInArrow(run, schema))


def solve_lattice(blocks: DataFrame, model: DataFrame, cell: float = 10.0, keys=("codigo", "variable"),
                  tol: float = 1e-11, max_rounds: int = 100) -> DataFrame:
    """Solutions of C u = value - mean and C v = 1 on ``blocks`` under ``model`` (keys, nugget, psill, range):
    the blocks with psill, c0, range, mean, ``x`` (u and v, packed) and ``rounds``.

    A group without a model or with a zero sill has c0 = 1 and no covariance between nodes.  Ends at a
    residual of ``tol`` times the right side in every group; raises if that is not reached."""
    keys = list(keys)
    kinds = dict(blocks.dtypes)

    def begin(batches):
        for rb in batches:
            total, n = [], []
            for value, mask in zip(rb.column(rb.schema.get_field_index("value")), rb.column(rb.schema.get_field_index("mask"))):
                total.append(float(_grid(value.as_py()).sum()))
                n.append(int(_grid(mask.as_py(), bool).sum()))
            yield pa.RecordBatch.from_arrays([*[rb.column(k) for k in range(len(keys))], pa.array(total), pa.array(n)], names=[*keys, "total", "n"])

    mean = blocks.select(*keys, "value", "mask").mapInArrow(begin, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", total double, n long")
    mean = mean.groupBy(*keys).agg((F.sum("total") / F.sum("n")).alias("mean"))
    psill, sill = F.coalesce("psill", F.lit(0.0)), F.coalesce(F.col("psill") + F.col("nugget"), F.lit(0.0))
    usable = (psill > 0) & (F.col("range") > 0)
    groups = mean.join(model.select(*keys, "nugget", "psill", "range"), keys, "left").select(
        *keys, "mean", F.when(usable, psill).otherwise(0.0).alias("psill"), F.when(sill > 0, sill).otherwise(1.0).alias("c0"), F.when(usable, F.col("range")).otherwise(float(cell)).alias("range"))
    fixed = [*keys, "x0", "y0", "nx", "ny", "bx", "by", "mask", "value", "mean", "psill", "c0", "range"]
    base = join_small(blocks, groups, keys).select(*fixed)
    fits = F.col("nx").cast("long") * F.col("ny") <= LOCAL_CELLS
    far = base.filter(~fits)
    if far.isEmpty():
        return _solve_whole(base, keys, fixed, cell, tol)
    near, base = _solve_whole(base.filter(fits), keys, fixed, cell, tol), far
    zero = F.lit(bytes(16 * _CELLS))

    def start(batches):
        for rb in batches:
            out = []
            for value, mask, m in zip(*(rb.column(rb.schema.get_field_index(c)) for c in ("value", "mask", "mean"))):
                there = _grid(mask.as_py(), bool)
                out.append(np.stack([(_grid(value.as_py()) - m.as_py()) * there, there.astype(float)]).tobytes())
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(out, pa.binary())], names=[*rb.schema.names, "r"])

    all_kinds = dict(base.dtypes)
    head = ", ".join(f"{c} {all_kinds[c]}" for c in fixed)
    state = base.mapInArrow(start, head + ", r binary").withColumns({c: zero for c in _STATE[1:]})
    state = state.withColumns({c: F.lit(0.0) for c in [*_SUMS, *_OLD]})
    schema = head + "".join(f", {c} binary" for c in _STATE) + "".join(f", {c} double" for c in [*_SUMS, *_OLD])
    names = [*fixed, *_STATE, *_SUMS, *_OLD]

    def step(batches):
        for rb in batches:
            columns = {c: rb.column(i).to_pylist() for i, c in enumerate(rb.schema.names)}
            for k in range(len(rb)):
                v = {c: columns[c][k] for c in columns}
                a, scalars = _advance(v, tol)
                v |= {c: a[c].tobytes() for c in ("r", "x", "p", "s")} | dict(zip(_OLD, scalars))
                yield pa.RecordBatch.from_arrays([pa.array([v[c]], rb.schema.field(c).type) for c in names], names=names)

    def apply(t: pa.Table) -> pa.Table:
        """z = M r and w = C z of the group's own block, with its shares of the sums."""
        mine = np.flatnonzero((t["ex"].to_numpy() == 0) & (t["ey"].to_numpy() == 0))
        if not len(mine):  # a block of the lattice without nodes
            return out_schema.empty_table()
        row = t.slice(int(mine[0]), 1).to_pylist()[0]
        st = Stencil(row, cell)
        around = st.ry + 1 + 2 * NEAR, st.rx + 1 + 2 * NEAR
        r = _mosaic(t, "r", around, layers=2)
        mask = _mosaic(t, "mask", around, bool)[0]
        z = st.precondition(r, mask)
        w = st.convolve(z) * _grid(row["mask"], bool)
        z, own = z[:, st.ry + 1:st.ry + 1 + BLOCK, st.rx + 1:st.rx + 1 + BLOCK], _grid(row["r"], layers=2)
        row |= {"z": np.ascontiguousarray(z).tobytes(), "w": np.ascontiguousarray(w).tobytes()}
        for k, side in enumerate("uv"):
            row |= {"rz" + side: float((own[k] * z[k]).sum()), "wz" + side: float((w[k] * z[k]).sum()), "rr" + side: float((own[k] * own[k]).sum())}
        return pa.Table.from_pylist([{c: row[c] for c in names}], out_schema)

    arrow = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    out_schema = pa.schema([(c, arrow[k]) for c, k in [(c, all_kinds[c]) for c in fixed] + [(c, "binary") for c in _STATE] + [(c, "double") for c in [*_SUMS, *_OLD]]])
    group = [*keys, "bx", "by"]
    carried = [*keys, "mask", "r"]
    own = [c for c in names if c not in (*carried, "bx", "by")]
    reach = F.when(F.col("psill") > 0, F.ceil(F.col("range") / cell)).otherwise(0) + 1 + 2 * NEAR
    for done in range(max_rounds + 1):
        state = cut_lineage(dealt(_spread(state, reach, carried, own), *group).groupBy(*group).applyInArrow(apply, schema))
        sums = cut_lineage(state.groupBy(*keys).agg(*[F.sum(c).alias(f"sum_{c}") for c in _SUMS], *[F.max(f"first{s}").alias(f"at_first{s}") for s in "uv"]))
        left = sums.agg(*[F.max(F.when(F.col(f"at_first{s}") > 0, F.col(f"sum_rr{s}") / F.col(f"at_first{s}")).otherwise(F.col(f"sum_rr{s}"))).alias(s) for s in "uv"]).first()
        if max(left.u or 0.0, left.v or 0.0) <= tol * tol:
            return near.unionByName(state.select(*fixed, "x", F.lit(done).alias("rounds")))
        small = stored_bytes(sums) <= BROADCAST_MAX_BYTES
        state = state.join(F.broadcast(sums) if small else sums, keys).mapInArrow(step, schema)
    raise RuntimeError("kriging systems did not converge")


def krige_lattice(solved: DataFrame, cell: float = 10.0, keys=("codigo", "variable")) -> DataFrame:
    """The kriged value at the centre of every cell between four lattice places: keys, row (0 on top), col, value."""
    keys = list(keys)
    kinds = dict(solved.dtypes)

    def parts(batches):
        for rb in batches:
            x = [_grid(v.as_py(), layers=2).sum(axis=(1, 2)) for v in rb.column(rb.schema.get_field_index("x"))]
            yield pa.RecordBatch.from_arrays([*[rb.column(k) for k in range(len(keys))], pa.array([float(a[0]) for a in x]), pa.array([float(a[1]) for a in x])], names=[*keys, "u", "v"])

    middle = solved.select(*keys, "x").mapInArrow(parts, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", u double, v double").groupBy(*keys).agg((F.sum("u") / F.sum("v")).alias("m"))
    groups = solved.groupBy(*keys, "nx", "ny", "mean", "psill", "c0", "range").agg(F.lit(None).cast("binary").alias("x"))
    groups = cut_lineage(groups.join(middle, keys))
    fits = F.col("nx").cast("long") * F.col("ny") <= LOCAL_CELLS
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", row int, col int, value double"

    def whole(t: pa.Table) -> pa.Table:
        g = t.select([*keys, "nx", "ny", "mean", "m", "psill", "c0", "range"]).slice(0, 1).to_pylist()[0]
        shape = g["ny"], g["nx"]
        x = _whole(t, "x", shape, layers=2)
        value = (g["mean"] + g["m"] + Stencil(g, cell).whole(shape, 0.5)((x[0] - g["m"] * x[1])[None])[0])[:-1, :-1]
        j, i = np.indices(value.shape, np.int32)
        return pa.table([*[pa.repeat(pa.scalar(g[k], t.schema.field(k).type), value.size) for k in keys], pa.array(g["ny"] - 2 - j.ravel(), pa.int32()), pa.array(i.ravel()), pa.array(value.ravel())],
                        names=[*keys, "row", "col", "value"])

    near = join_small(solved.select(*keys, "nx", "ny", "bx", "by", "psill", "c0", "range", "mean", "x").filter(fits), groups.select(*keys, "m"), keys)
    near = _apart(near, keys).groupBy(*keys).applyInArrow(whole, schema)
    groups, solved = groups.filter(~fits), solved.filter(~fits)
    if groups.isEmpty():
        return near
    # every block of the lattice gets a row, also those without nodes
    last = lambda n: F.sequence(F.lit(0), F.floor((F.col(n) - 1) / BLOCK).cast("int"))
    wanted = groups.withColumn("bx", F.explode(last("nx"))).withColumn("by", F.explode(last("ny")))
    wanted = wanted.select(*keys, "nx", "ny", "mean", "m", "psill", "c0", "range", "bx", "by", F.lit(99).alias("ex"), F.lit(0).alias("ey"), "x")
    reach = F.when(F.col("psill") > 0, F.ceil(F.col("range") / cell)).otherwise(0) + 2
    sent = _spread(join_small(solved.drop("mean", "psill", "c0", "range", "nx", "ny"), groups.drop("x"), keys), reach, [*keys, "nx", "ny", "mean", "m", "psill", "c0", "range", "x"], [])

    def apply(t: pa.Table) -> pa.Table:
        g = {c: t[c][0].as_py() for c in [*keys, "nx", "ny", "mean", "m", "psill", "c0", "range", "bx", "by"]}
        st = Stencil(g, cell)
        near = t.filter(pa.compute.is_valid(t["x"]))
        x = _mosaic(near, "x", (st.ry + 1, st.rx + 1), layers=2) if len(near) else np.zeros((2, BLOCK + 2 * st.ry + 2, BLOCK + 2 * st.rx + 2))
        value = g["mean"] + g["m"] + st.convolve((x[0] - g["m"] * x[1])[None], 0.5)[0]
        i, j = np.meshgrid(np.arange(BLOCK) + g["bx"] * BLOCK, np.arange(BLOCK) + g["by"] * BLOCK)
        inside = (i < g["nx"] - 1) & (j < g["ny"] - 1)
        n = int(inside.sum())
        return pa.table([*[pa.array([g[k]] * n, pa.string()) for k in keys], pa.array((g["ny"] - 2 - j[inside]).astype(np.int32)), pa.array(i[inside].astype(np.int32)), pa.array(value[inside])],
                        names=[*keys, "row", "col", "value"])

    return near.unionByName(dealt(sent.select(wanted.columns).unionByName(wanted), *keys, "bx", "by").groupBy(*keys, "bx", "by").applyInArrow(apply, schema))


def lattice_product(solved: DataFrame, cell: float = 10.0, keys=("codigo", "variable")) -> DataFrame:
    """C u + mean at every node, summed offset by offset (no transform), beside the datum there: keys, x, y,
    value, datum.  The check of ``solve_lattice``: they are equal."""
    keys = list(keys)
    kinds = dict(solved.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", x double, y double, value double, datum double"
    fits = F.col("nx").cast("long") * F.col("ny") <= LOCAL_CELLS

    def whole(t: pa.Table) -> pa.Table:
        """The lattice row by row, offset by offset (``Stencil.by_offsets``)."""
        g = t.select([*keys, "x0", "y0", "nx", "ny", "mean", "psill", "c0", "range"]).slice(0, 1).to_pylist()[0]
        shape = g["ny"], g["nx"]
        mask, value, u = _whole(t, "mask", shape, bool)[0], _whole(t, "value", shape)[0], _whole(t, "x", shape, layers=2)[0]
        total = Stencil(g, cell).by_offsets(u)
        j, i = np.nonzero(mask)
        return pa.table([*[pa.repeat(pa.scalar(g[k], t.schema.field(k).type), len(i)) for k in keys], pa.array(g["x0"] + i * cell), pa.array(g["y0"] + j * cell),
                         pa.array(total[j, i] + g["mean"]), pa.array(value[j, i])], names=[*keys, "x", "y", "value", "datum"])

    near = _apart(solved.filter(fits), keys).groupBy(*keys).applyInArrow(whole, schema)
    solved = solved.filter(~fits)
    if solved.isEmpty():
        return near
    reach = F.when(F.col("psill") > 0, F.ceil(F.col("range") / cell)).otherwise(0) + 1
    sent = _spread(solved, reach, [*keys, "x", "psill", "c0", "range"], ["x0", "y0", "nx", "ny", "mean", "mask", "value"])

    def apply(t: pa.Table) -> pa.Table:
        mine = np.flatnonzero((t["ex"].to_numpy() == 0) & (t["ey"].to_numpy() == 0))
        names = [*keys, "x", "y", "value", "datum"]
        if not len(mine):
            return pa.table([pa.array([], pa.string() if c in keys else pa.float64()) for c in names], names=names)
        row = t.slice(int(mine[0]), 1).to_pylist()[0]
        st = Stencil(row, cell)
        u = _mosaic(t, "x", (st.ry, st.rx), layers=2)[0]
        total = np.zeros((BLOCK, BLOCK))
        for dy in range(-st.ry, st.ry + 1):
            for dx in range(-st.rx, st.rx + 1):
                c = float(st.at(np.float64(dx), np.float64(dy)))
                if c:
                    total += c * u[st.ry + dy:st.ry + dy + BLOCK, st.rx + dx:st.rx + dx + BLOCK]
        j, i = np.nonzero(_grid(row["mask"], bool))
        return pa.table([*[pa.array([row[k]] * len(i), pa.string()) for k in keys], pa.array(row["x0"] + (i + row["bx"] * BLOCK) * cell),
                         pa.array(row["y0"] + (j + row["by"] * BLOCK) * cell), pa.array(total[j, i] + row["mean"]), pa.array(_grid(row["value"])[j, i])], names=names)

    return near.unionByName(dealt(sent, *keys, "bx", "by").groupBy(*keys, "bx", "by").applyInArrow(apply, schema))
