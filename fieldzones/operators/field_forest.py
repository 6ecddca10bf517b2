"""A random forest for each field and soil variable.

The samples of a field and variable meet runs of its trees; a task grows a run level by level, all open nodes
at once, over samples sorted by each predictor (samples of equal predictors count as one).  Groups of more
than ``LOCAL_SAMPLES`` grow in rounds instead, one level of all trees a round: rows are (field, variable,
tree, node, sample) with the sample's weight in the tree; one aggregate over (field, variable, tree, node,
predictor, bin) gives the histograms of every open node, running sums over the bins its split points, and the
best one is joined back.  Draws and splits are the same.  Nothing is fitted on the driver and no forest in one task.

* Bins: the different values of a predictor in the field (``max_bins`` at most, then ranges of equal
  rank); a split point is the middle between two neighbouring bins.
* Bootstrap: tree t draws sample ``hash(seed, field, variable, t, d) mod n`` for d = 0 .. n - 1.
* Predictors of a node: the ``max_features`` of least ``hash(seed, field, variable, t, node, predictor)``.
* Split: greatest decrease of the squared deviations; equal ones (6 places): first predictor, then bin.
* Importance: the decrease by predictor, shares within each tree, averaged over the trees that split.
* Prediction: runs of at most ``RUN`` points of a field stay in a task while the field's trees, flattened into arrays
  of some ``NODES`` nodes, pass by, ``HELD`` nodes of a variable at a time.  The thresholds cut the space of
  the predictors into cells, and all points of a cell get the same value from every tree: where the cells that a block
  of points lies among are fewer work than the trees, each leaf is added to its cells (differences at the corners,
  running sums, whole numbers) and a point looks up its cell.  Otherwise trees are cut into pages of 6 levels, and a
  point's way through a page is one AND of a 64-bit word for each predictor.

Samples without a value of the variable or of a predictor are left out (P6); a variable of one sample or
without spread is its mean everywhere.  Missing predictors of the grid take the field's mean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldzones.operators.samples import coerce_numeric, present
from fieldzones.operators.stats import impute_mean
from fieldzones.session import cut_lineage, dealt, join_small, parallelism

THRESHOLD = 0.05
MAX_BINS, MAX_DEPTH = 256, 30
#: Samples of a group whose trees grow inside tasks, least trees of a run, drawn samples grown at a time.
LOCAL_SAMPLES, TREES, DRAWN = 1_000_000, 25, 1 << 17
#: Nodes of a chunk of trees and of the trees that a task holds, points of a run (most, least), cells of a table.
NODES, HELD, RUN, SMALL, CELLS = 1 << 18, 1 << 21, 1 << 20, 1 << 14, 1 << 22
#: Points a tree takes at a time, words of a tree's pages; seconds that a point in a tree, a cell and a node cost.
STRIDE, WORDS, WALK, CELL, NODE = 1 << 14, 1 << 22, 5e-8, 1e-8, 1e-7
PAGE = 6
_GROUP = ["codigo", "variable"]


def _hash(*parts):
    return F.xxhash64(*[p if not isinstance(p, (int, str)) else F.lit(p) for p in parts])


def training_rows(train: DataFrame, variables: list[str], predictors: list[str], max_bins: int = MAX_BINS):
    """(rows, bins): rows of codigo, variable, idx, n, y, xb (bin of each predictor); bins of codigo,
    variable, f, bin, low, high (its least and greatest value)."""
    data = coerce_numeric(train, [*predictors, *variables])
    x = F.array(*[F.col(p).cast("double") for p in predictors])
    long = data.select("codigo", x.alias("x"), F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("y")) for v in variables])).alias("v"))
    long = long.select("codigo", "v.variable", "v.y", "x").filter(F.col("y").isNotNull() & ~F.exists("x", lambda e: e.isNull()))
    by = Window.partitionBy(*_GROUP)
    long = cut_lineage(long.withColumns({"idx": F.row_number().over(by.orderBy("x", "y")) - 1, "n": F.count(F.lit(1)).over(by)}))
    flat = long.select(*_GROUP, "idx", F.posexplode("x").alias("f", "value"))
    of = Window.partitionBy(*_GROUP, "f").orderBy("value")
    flat = flat.withColumn("rank", F.dense_rank().over(of))
    flat = flat.withColumn("different", F.max("rank").over(Window.partitionBy(*_GROUP, "f")))
    place = F.when(F.col("different") <= max_bins, F.col("rank") - 1).otherwise(F.floor((F.col("rank") - 1) * max_bins / F.col("different"))).cast("int")
    flat = cut_lineage(flat.select(*_GROUP, "idx", "f", "value", place.alias("bin")))
    bins = flat.groupBy(*_GROUP, "f", "bin").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    binned = flat.groupBy(*_GROUP, "idx").agg(F.array_sort(F.collect_list(F.struct("f", "bin"))).alias("b"))
    rows = long.select(*_GROUP, "idx", "n", "y").join(binned, [*_GROUP, "idx"]).select(*_GROUP, "idx", "n", "y", F.col("b.bin").alias("xb"))
    return cut_lineage(rows), cut_lineage(bins)


def _drawn(rows: DataFrame, num_trees: int, seed: int, bootstrap: bool) -> DataFrame:
    """rows for each tree, with their weight in it."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(num_trees - 1))).alias("tree")
    if not bootstrap:
        return rows.select(*_GROUP, tree, "y", "xb", F.lit(1.0).alias("w"))
    draws = rows.select(*_GROUP, "n", "idx", tree)
    draws = draws.select(*_GROUP, "tree", F.pmod(_hash(seed, F.col("codigo"), F.col("variable"), F.col("tree"), F.col("idx")), F.col("n")).alias("idx"))
    draws = draws.groupBy(*_GROUP, "tree", "idx").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return join_small(draws, rows.select(*_GROUP, F.col("idx").cast("long").alias("idx"), "y", "xb"), [*_GROUP, "idx"]).select(*_GROUP, "tree", "y", "xb", "w")


def _grown_by_rounds(rows: DataFrame, bins: DataFrame, allowed: DataFrame | None, n_predictors: int, num_trees: int,
                     seed: int, max_features: int, max_depth: int, bootstrap: bool, every_bin: bool) -> DataFrame:
    """``grow`` for groups of any size: a level of all trees is one round over all tasks."""
    if allowed is None:
        open_ = _drawn(rows, num_trees, seed, bootstrap).withColumn("fs", F.sequence(F.lit(0), F.lit(n_predictors - 1)))
    else:
        open_ = join_small(_drawn(rows, num_trees, seed, bootstrap), allowed.select(*_GROUP, "fs"), _GROUP)
    open_ = cut_lineage(dealt(open_.withColumn("node", F.lit(1).cast("long")), *_GROUP, "tree"))
    node_key = [*_GROUP, "tree", "node"]
    nodes = None
    for depth in range(max_depth + 1):
        total = open_.groupBy(*node_key).agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("y")).alias("s"),
                                             F.min("y").alias("least"), F.max("y").alias("most"))
        if depth < max_depth:
            order = F.array_sort(F.transform("fs", lambda f: F.struct(_hash(seed, F.col("codigo"), F.col("variable"), F.col("tree"), F.col("node"), f).alias("h"), f.alias("f"))))
            drawn = open_.select(*node_key, "w", "y", "xb", F.explode(F.slice(order, 1, max_features)).alias("o"))
            hist = drawn.groupBy(*node_key, F.col("o.f").alias("f"), F.get("xb", F.col("o.f")).alias("bin")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s"))
            side = Window.partitionBy(*node_key, "f")
            up = side.orderBy("bin")
            hist = hist.withColumns({"wl": F.sum("w").over(up), "sl": F.sum("s").over(up), "wt": F.sum("w").over(side), "st": F.sum("s").over(side), "after": F.lead("bin").over(up)})
            gain = F.col("sl") * F.col("sl") / F.col("wl") + (F.col("st") - F.col("sl")) * (F.col("st") - F.col("sl")) / (F.col("wt") - F.col("wl")) - F.col("st") * F.col("st") / F.col("wt")
            best = hist.filter("after IS NOT NULL").withColumn("gain", F.round(gain, 6)).groupBy(*node_key).agg(
                F.max_by(F.struct("f", "bin", "after", "gain"), F.struct("gain", -F.col("f"), -F.col("bin"))).alias("b"))
            total = total.join(best, node_key, "left")
            split = (F.col("b.gain") > 0) & (F.col("most") > F.col("least"))
            total = total.select(*node_key, "weight", (F.col("s") / F.col("weight")).alias("value"), *[F.when(split, F.col(f"b.{c}")).alias(c) for c in ("f", "bin", "after", "gain")])
        else:
            total = total.select(*node_key, "weight", (F.col("s") / F.col("weight")).alias("value"), *[F.lit(None).cast(t).alias(c) for c, t in (("f", "int"), ("bin", "int"), ("after", "int"), ("gain", "double"))])
        level = cut_lineage(total)
        nodes = level if nodes is None else nodes.unionByName(level)
        splits = level.filter("f IS NOT NULL")
        if depth == max_depth or splits.isEmpty():
            break
        right = (F.get("xb", F.col("f")) > F.col("bin")).cast("long")
        open_ = cut_lineage(dealt(open_.join(splits.select(*node_key, "f", "bin"), node_key).withColumn("node", F.col("node") * 2 + right).drop("f", "bin"), *_GROUP, "tree"))
    low = bins.select(*_GROUP, "f", F.col("bin").alias("bin"), F.col("high").alias("left_high"))
    high = bins.select(*_GROUP, "f", F.col("bin").alias("after"), F.col("low").alias("right_low"))
    if every_bin:
        nodes = nodes.withColumn("after", F.col("bin") + 1)
    nodes = join_small(join_small(nodes, low, [*_GROUP, "f", "bin"], "left"), high, [*_GROUP, "f", "after"], "left")
    return cut_lineage(nodes.select(*node_key, "weight", "value", "f", ((F.col("left_high") + F.col("right_low")) / 2).alias("threshold"), "gain"))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def hash_int(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """``xxhash64`` of an int (0 or more) after the columns hashed to ``seed``; unsigned."""
    h = (seed + _P5 + np.uint64(4)) ^ (value.astype(np.uint64) * _P1)
    return _mixed(_turned(h, 23) * _P2 + _P3)


def hash_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = (seed + _P5 + np.uint64(8)) ^ (_turned(value.astype(np.uint64) * _P2, 31) * _P1)
    return _mixed(_turned(h, 27) * _P1 + _P4)


def _cells(xb: np.ndarray, fs) -> np.ndarray:
    """Number of each sample's bins of the predictors ``fs``, equal for equal bins."""
    code = np.zeros(len(xb), np.int64)
    for f in fs:
        code = np.unique(code * (int(xb[:, f].max()) + 1) + xb[:, f], return_inverse=True)[1]
    return code


def _drawn_cells(y: np.ndarray, cell: np.ndarray, h: np.ndarray | None, n_trees: int):
    """(tree, cell, weight, sum, least, greatest y) for every tree and cell with a drawn sample; ``h``: the
    hashes of the trees, None without bootstrap."""
    n, order = len(y), np.lexsort((y, cell))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    if h is None:
        w = np.ones(n_trees * n)
    else:
        at = hash_int(np.arange(n)[None], h[:, None]).view(np.int64) % n
        w = np.bincount((place[at] + n * np.arange(n_trees)[:, None]).ravel(), minlength=n_trees * n).astype(float)
    have = np.flatnonzero(w)
    tree, k = have // n, order[have % n]
    of = cell[k]
    first = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (of[1:] != of[:-1])])
    last = np.r_[first[1:], len(have)] - 1
    return tree[first], of[first], np.add.reduceat(w[have], first), np.add.reduceat(w[have] * y[k], first), y[k[first]], y[k[last]]


def _grow_run(y: np.ndarray, xb: np.ndarray, fs: list[int], trees: np.ndarray, h: np.ndarray, max_features: int, max_depth: int, bootstrap: bool):
    """Nodes of the given trees of one group, an array for each of tree, node, weight, value, f (-1: a leaf),
    bin, after, gain.  ``y`` is taken from its mean, and sums run over long doubles, so that equal splits tie."""
    mean = y.mean()
    y = y - mean
    cell = _cells(xb, fs)
    example = np.empty(int(cell.max()) + 1, np.int64)
    example[cell] = np.arange(len(y))
    slot, of, w, s, least, most = _drawn_cells(y, cell, hash_int(trees, h) if bootstrap else None, len(trees))
    x = [np.ascontiguousarray(xb[example[of], f]) for f in fs]
    orders = [np.lexsort((v, slot)) for v in x] or [np.arange(len(slot))]
    tree, node, found = trees, np.ones(len(trees), np.int64), []
    for depth in range(max_depth + 1):
        o = orders[0]
        sizes = np.bincount(slot[o], minlength=len(tree))
        starts = np.cumsum(sizes) - sizes
        wt, st = np.add.reduceat(w[o], starts), np.add.reduceat(s[o], starts)
        best, f_best, bin_best, after = np.zeros(len(tree)), *(np.full(len(tree), -1, np.int32) for _ in range(3))
        if depth < max_depth:
            open_ = np.maximum.reduceat(most[o], starts) > np.minimum.reduceat(least[o], starts)
            drawn = None
            if max_features < len(fs):
                base = hash_long(node, hash_int(tree, h))
                rank = np.argsort(np.stack([hash_int(np.full(1, f), base).view(np.int64) for f in fs], 1), axis=1, kind="stable")[:, :max_features]
                drawn = np.zeros((len(tree), len(fs)), bool)
                np.put_along_axis(drawn, rank, True, axis=1)
            for i, f in enumerate(fs):
                o, v = orders[i], x[i][orders[i]]
                here = slot[o]
                c = np.flatnonzero((here[1:] == here[:-1]) & (v[1:] != v[:-1]))
                c = c[(open_ if drawn is None else open_ & drawn[:, i])[here[c]]]
                if not len(c):
                    continue
                wl, sl = np.cumsum(w[o]), np.cumsum(s[o], dtype=np.longdouble)
                at = here[c]
                wl, sl = wl[c] - (wl[starts] - w[o[starts]])[at], (sl[c] - (sl[starts] - s[o[starts]])[at]).astype(float)
                sr = st[at] - sl
                gain = np.round(sl * sl / wl + sr * sr / (wt[at] - wl) - st[at] * st[at] / wt[at], 6)
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                top = np.maximum.reduceat(gain, first)
                hit = np.flatnonzero(gain == np.repeat(top, np.diff(np.r_[first, len(at)])))[::-1]
                pick = np.empty(len(tree), np.int64)
                pick[at[hit]] = c[hit]  # the first of equal gains is written last
                own = at[first]
                own = own[top > best[own]]
                gains = np.zeros(len(tree))
                gains[at[first]] = top
                best[own], f_best[own], bin_best[own], after[own] = gains[own], i, v[pick[own]], v[pick[own] + 1]
        split = f_best >= 0
        found.append((tree, node, wt, st / wt + mean, np.where(split, np.array([*fs, -1], np.int32)[f_best], -1), bin_best, after, best))
        if not split.any():
            break
        number = np.cumsum(split) - 1
        right = np.zeros(len(slot), bool)
        for i in range(len(fs)):
            o = orders[0][f_best[slot[orders[0]]] == i]
            right[o] = x[i][o] > bin_best[slot[o]]
        for i, o in enumerate(orders):
            o = o[split[slot[o]]]
            r, g = number[slot[o]], right[o]
            n_all, n_right = np.bincount(r), np.bincount(r, weights=g).astype(np.int64)
            before, rights = np.cumsum(n_all) - n_all, np.cumsum(n_right) - n_right
            up = np.cumsum(g)
            lefts_at = np.arange(len(o)) - up + g + rights[r]  # lefts of earlier nodes stand in ``before`` with their rights
            to = np.where(g, before[r] + (n_all - n_right)[r] + up - 1 - rights[r], lefts_at)
            moved = np.empty_like(o)
            moved[to] = o
            orders[i] = moved
        o = orders[0]
        slot[o] = 2 * number[slot[o]] + right[o]
        tree, node = np.repeat(tree[split], 2), (2 * node[split][:, None] + np.arange(2)).ravel()
    return [np.concatenate(c) for c in zip(*found)]


def _grown_in_tasks(rows: DataFrame, bins: DataFrame, allowed: DataFrame | None, n_predictors: int, num_trees: int,
                    seed: int, max_features: int, max_depth: int, bootstrap: bool, every_bin: bool) -> DataFrame:
    """``grow`` for groups of at most ``LOCAL_SAMPLES``: a task has a group's samples and a run of its trees."""
    packed = rows.groupBy(*_GROUP).agg(F.array_sort(F.collect_list(F.struct("idx", "y", "xb"))).alias("r"))
    edges = bins.groupBy(*_GROUP).agg(F.array_sort(F.collect_list(F.struct("f", "bin", "low", "high"))).alias("e"))
    packed = packed.join(edges, _GROUP).select(*_GROUP, _hash(seed, F.col("codigo"), F.col("variable")).alias("h"), F.col("r.y").alias("y"), F.flatten("r.xb").alias("xb"),
                                               F.col("e.f").alias("ef"), F.col("e.low").alias("low"), F.col("e.high").alias("high"))
    if allowed is None:
        packed = packed.withColumn("fs", F.sequence(F.lit(0), F.lit(n_predictors - 1)))
    else:
        packed = packed.join(allowed.select(*_GROUP, "fs"), _GROUP)
    run_of = F.greatest(F.lit(TREES), F.least(F.lit(10 * TREES), F.floor(F.lit(DRAWN) / F.size("y")))).cast("int")
    packed = cut_lineage(packed.withColumn("size", run_of))
    runs = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(num_trees - 1), F.col("size"))).alias("first"))
    runs = dealt(runs, *_GROUP, "first")
    names, kind = runs.columns, dict(rows.dtypes)["codigo"]

    def run(batches):
        for rb in batches:
            for k in range(len(rb)):
                v = {c: rb.column(i)[k] for i, c in enumerate(names)}
                y, low, high, ef = (v[c].values.to_numpy(zero_copy_only=False) for c in ("y", "low", "high", "ef"))
                xb = v["xb"].values.to_numpy(zero_copy_only=False).reshape(len(y), n_predictors)
                h, fs = np.array([v["h"].as_py()], np.int64).view(np.uint64), sorted(v["fs"].as_py())
                last = min(v["first"].as_py() + v["size"].as_py(), num_trees)
                each = max(1, DRAWN // len(y))
                for t in range(v["first"].as_py(), last, each):
                    tree, node, weight, value, f, b, after, gain = _grow_run(y, xb, fs, np.arange(t, min(t + each, last)), h, max_features, max_depth, bootstrap)
                    leaf, of = f < 0, np.searchsorted(ef, np.maximum(f, 0))
                    cut = (high[of + np.maximum(b, 0)] + low[np.minimum(of + np.maximum(b + 1 if every_bin else after, 0), len(low) - 1)]) / 2
                    n = len(tree)
                    yield pa.RecordBatch.from_arrays([pa.array([v["codigo"].as_py()] * n, rb.schema.field("codigo").type), pa.array([v["variable"].as_py()] * n), pa.array(tree.astype(np.int32)), pa.array(node), pa.array(weight), pa.array(value),
                                                      pa.array(f.astype(np.int32), mask=leaf), pa.array(cut, mask=leaf), pa.array(gain, mask=leaf)], names=[*_GROUP, "tree", "node", "weight", "value", "f", "threshold", "gain"])

    return runs.mapInArrow(run, f"codigo {kind}, variable string, tree int, node long, weight double, value double, f int, threshold double, gain double")


def grow(rows: DataFrame, bins: DataFrame, allowed: DataFrame | None, n_predictors: int, num_trees: int = 1500, seed: int = 42,
         max_features: int = 3, max_depth: int = MAX_DEPTH, bootstrap: bool = True, every_bin: bool = False) -> DataFrame:
    """Nodes of all trees: codigo, variable, tree, node (children 2k, 2k + 1; root 1), weight, value, f,
    threshold, gain (null: a leaf).  ``allowed`` (codigo, variable, fs) restricts a forest's predictors.
    ``every_bin``: a threshold lies next to the bin's neighbour in the group, not in the node."""
    given = (allowed, n_predictors, num_trees, seed, max_features, max_depth, bootstrap, every_bin)
    large = rows.filter(F.col("n") > LOCAL_SAMPLES)
    nodes = _grown_in_tasks(rows.filter(F.col("n") <= LOCAL_SAMPLES), bins, *given)
    if not large.isEmpty():
        nodes = nodes.unionByName(_grown_by_rounds(large, bins, *given))
    return cut_lineage(nodes)


def importances(nodes: DataFrame, predictors: list[str]) -> DataFrame:
    """M6/O1: codigo, variable, predictor, importance, rank; all zero where no tree splits."""
    gains = nodes.filter("f IS NOT NULL").groupBy(*_GROUP, "tree", "f").agg(F.sum("gain").alias("g"))
    shares = gains.withColumn("share", F.col("g") / F.sum("g").over(Window.partitionBy(*_GROUP, "tree")))
    split = gains.groupBy(*_GROUP).agg(F.count_distinct("tree").alias("trees"))
    found = shares.groupBy(*_GROUP, "f").agg(F.sum("share").alias("t"))
    names = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.lit(p).alias("predictor")) for i, p in enumerate(predictors)]))
    every = nodes.select(*_GROUP).distinct().select(*_GROUP, names.alias("p")).select(*_GROUP, "p.f", "p.predictor")
    out = every.join(found, [*_GROUP, "f"], "left").join(split, _GROUP, "left")
    out = out.select(*_GROUP, "predictor", "f", F.coalesce(F.col("t") / F.col("trees"), F.lit(0.0)).alias("importance"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*_GROUP).orderBy(F.desc("importance"), "predictor")))


class FieldForests:
    """Forests of all fields: ``importances``, and ``nodes`` refitted on the selected predictors."""

    def __init__(self, predictors: list[str], importances: DataFrame, nodes: DataFrame):
        self.predictors, self.importances, self.nodes = predictors, importances, nodes


def fit(train: DataFrame, variables: list[str], predictors: list[str], num_trees: int = 1500, seed: int = 42,
        max_features: int = 3, threshold: float = THRESHOLD) -> FieldForests:
    """Importances per field and variable, then forests on the predictors above ``threshold``.

    A forest without such a predictor keeps the root of its trees, the mean."""
    have, _ = present(train.columns, variables)
    rows, bins = training_rows(train, have, predictors)
    first = grow(rows, bins, None, len(predictors), num_trees, seed, max_features)
    imp = cut_lineage(importances(first, predictors))
    chosen = F.array_sort(F.collect_list(F.when(F.col("importance") > threshold, F.col("f"))))
    allowed = imp.groupBy(*_GROUP).agg(chosen.alias("fs"))
    return FieldForests(predictors, imp.drop("f"), grow(rows, bins, allowed, len(predictors), num_trees, seed, max_features))


def _packed_trees(nodes: DataFrame) -> DataFrame:
    """Chunks of trees of a forest as arrays: feature (-1: leaf), threshold or a leaf's value, left child, roots."""
    sizes = nodes.groupBy(*_GROUP).agg(F.ceil(F.count(F.lit(1)) / NODES).alias("chunks"), (F.max("tree") + 1).alias("trees"))
    rows = join_small(nodes, sizes, _GROUP).withColumn("chunk", F.floor(F.col("tree") * F.col("chunks") / F.col("trees")).cast("int"))
    number = F.coalesce("threshold", "value").alias("number")
    lists = dealt(rows, *_GROUP, "chunk").groupBy(*_GROUP, "chunk").agg(F.array_sort(F.collect_list(F.struct("tree", "node", F.coalesce("f", F.lit(-1)).cast("int").alias("f"), number))).alias("t"))
    lists = lists.select(*_GROUP, "chunk", *[F.col(f"t.{c}").alias(c) for c in ("tree", "node", "f", "number")])

    def pack(batches):
        for rb in batches:
            for k in range(len(rb)):
                tree, node, f, number = (rb.column(c)[k].values.to_numpy() for c in (3, 4, 5, 6))
                roots = np.flatnonzero(node == 1)
                size = np.diff(np.r_[roots, len(node)])
                # nodes of a tree are sorted: below one level stand the two children of each of its inner nodes in turn
                inner = np.cumsum(f >= 0)
                left = np.where(f >= 0, np.repeat(roots, size) + 1 + 2 * (inner - 1 - np.repeat(inner[roots] - (f[roots] >= 0), size)), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[rb.column(c).slice(k, 1) for c in range(3)], *[pa.array([a.tobytes()], pa.binary()) for a in (f.astype(np.int16), number, left, roots.astype(np.int32))]],
                                                 names=[*_GROUP, "chunk", "f", "number", "left", "roots"])

    kind = dict(nodes.dtypes)["codigo"]
    return lists.mapInArrow(pack, f"codigo {kind}, variable string, chunk int, f binary, number binary, left binary, roots binary")


def walk(x: np.ndarray, f: np.ndarray, number: np.ndarray, left: np.ndarray, root: int) -> np.ndarray:
    """The leaf value that each row of ``x`` comes to in one tree; the right child follows the left."""
    at = np.full(len(x), root)
    going = np.arange(len(x)) if f[root] >= 0 else np.zeros(0, np.int64)
    while len(going):
        n = at[going]
        at[going] = left[n] + (x[going, f[n]] > number[n])
        going = going[f[at[going]] >= 0]
    return number[at]


def _below(n: np.ndarray) -> np.ndarray:
    """Words with the ``n`` lowest bits set (0 to 64)."""
    return np.where(n >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))


def _pages(f: np.ndarray, number: np.ndarray, left: np.ndarray, roots: np.ndarray):
    """Trees cut into pages of ``PAGE`` levels: for each inner node its page and the exits of the page that going
    right leaves out (mask); for each exit (64 a page, from left to right) its value and next page (-1: a leaf);
    the first page of each tree.  Pages of a tree follow each other, its root's first."""
    levels, at = [], roots[f[roots] >= 0]
    while len(at):
        levels.append(at)
        at = (left[at][:, None] + np.arange(2)).ravel()
        at = at[f[at] >= 0]
    exits, page, start = np.ones(len(f), np.int64), np.full(len(f), -1), np.zeros(len(f), np.int64)
    own = np.zeros(len(f), np.int64)
    for d in reversed(range(len(levels))):  # exits as the page above sees them: a page's root is one
        own[levels[d]] = exits[left[levels[d]]] + exits[left[levels[d]] + 1]
        exits[levels[d]] = own[levels[d]] if d % PAGE else 1
    tops = np.concatenate([levels[d] for d in range(0, len(levels), PAGE)] or [np.zeros(0, np.int64)]).astype(np.int64)
    tree = np.searchsorted(roots, tops, "right") - 1
    tops = tops[np.argsort(tree, kind="stable")]
    page[tops] = np.arange(len(tops))
    value, follow = np.zeros(64 * len(tops)), np.full(64 * len(tops), -1)
    for d, at in enumerate(levels):
        for side in (0, 1):
            child = left[at] + side
            place = start[at] + (exits[left[at]] if side else 0)
            out = (f[child] < 0) | ((d + 1) % PAGE == 0)
            start[child[~out]], page[child[~out]] = place[~out], page[at[~out]]
            slot, ends = 64 * page[at[out]] + place[out], f[child[out]] < 0
            value[slot[ends]] = number[child[out][ends]]
            follow[slot[~ends]] = page[child[out][~ends]]
    inner = np.flatnonzero(f >= 0)
    mask = ~(_below(start[inner] + exits[left[inner]]) & ~_below(start[inner]))
    return inner, page[inner], mask, value, follow, np.searchsorted(np.sort(tree), np.arange(len(roots) + 1))


def forest_sums(x: np.ndarray, f: np.ndarray, number: np.ndarray, left: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Sum over the trees of the leaf value that each row of ``x`` comes to."""
    total = np.full(len(x), number[roots[f[roots] < 0]].sum())
    inner, page, mask, value, follow, first = _pages(f, number, left, roots)
    used = np.unique(f[inner])
    cuts = {c: np.unique(number[inner[f[inner] == c]]) for c in used}
    rank = {c: np.where(np.isnan(x[:, c]), 0, np.searchsorted(cuts[c], x[:, c])) for c in used}  # cuts below the value
    tree = np.searchsorted(roots, inner, "right") - 1
    by = np.lexsort((f[inner], tree))
    ends = np.searchsorted(tree[by], np.arange(len(roots) + 1))
    for t in np.flatnonzero(f[roots] >= 0):
        mine, p0, pages = by[ends[t]:ends[t + 1]], first[t], first[t + 1] - first[t]
        if pages * sum(len(c) + 1 for c in cuts.values()) > WORDS:
            total += walk(x, f, number, left, roots[t])
            continue
        words = {}
        for c in np.unique(f[inner[mine]]):
            m = mine[f[inner[mine]] == c]
            table = np.full((pages, len(cuts[c]) + 1), ~np.uint64(0))
            np.bitwise_and.at(table, (page[m] - p0, np.searchsorted(cuts[c], number[inner[m]]) + 1), mask[m])
            words[c] = np.bitwise_and.accumulate(table, axis=1).ravel()
        for a in range(0, len(x), STRIDE):
            here, z = None, slice(a, a + STRIDE)
            ranks = {c: rank[c][z] for c in words}
            word = None
            for c, r in ranks.items():
                word = words[c][r] if word is None else word & words[c][r]
            out = 64 * p0 + np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1))
            total[z] += value[out]
            if pages == 1:
                continue
            going = follow[out]
            here = np.flatnonzero(going >= 0)
            while len(here):
                p, word = going[here] - p0, None
                for c, r in ranks.items():
                    bits = words[c][p * (len(cuts[c]) + 1) + r[here]]
                    word = bits if word is None else word & bits
                out = 64 * (p + p0) + np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1))
                total[a + here] += value[out]
                going[here] = follow[out]
                here = here[going[here] >= 0]
    return total


def _leaves(f: np.ndarray, q: np.ndarray, left: np.ndarray, roots: np.ndarray, column: np.ndarray, low: np.ndarray, high: np.ndarray):
    """The leaves of the trees that meet the box of cells from ``low`` to ``high``, with their part of it: nodes, lows,
    highs.  ``q``: number of an inner node's threshold among those of its predictor; cells up to it go left."""
    at, lo, hi, found = roots.astype(np.int64), np.repeat(low[None], len(roots), 0), np.repeat(high[None], len(roots), 0), []
    while len(at):
        leaf = f[at] < 0
        found.append((at[leaf], lo[leaf], hi[leaf]))
        at, lo, hi = at[~leaf], lo[~leaf], hi[~leaf]
        c, cut = column[f[at]], q[at]
        rows = np.arange(len(at))
        go_left, go_right = lo[rows, c] <= cut, hi[rows, c] > cut
        lo_right, hi_left = lo[go_right], hi[go_left]
        i, j = np.arange(len(hi_left)), np.arange(len(lo_right))
        hi_left[i, c[go_left]] = np.minimum(hi_left[i, c[go_left]], cut[go_left])
        lo_right[j, c[go_right]] = np.maximum(lo_right[j, c[go_right]], cut[go_right] + 1)
        at, lo, hi = np.r_[left[at[go_left]], left[at[go_right]] + 1].astype(np.int64), np.concatenate([lo[go_left], lo_right]), np.concatenate([hi_left, hi[go_right]])
    return [np.concatenate(v) for v in zip(*found)]


def _by_cells(rank: np.ndarray, lo: np.ndarray, hi: np.ndarray, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of the whole ``number`` of the leaves (boxes ``lo`` to ``hi``) that hold each row of ``rank``, from tables of
    at most ``CELLS`` cells of the box from ``low`` to ``high``."""
    out, size = np.zeros(len(rank), np.int64), high - low + 1
    axis = int(np.argmax(size))
    thick = max(1, int(CELLS // np.prod(np.delete(size, axis), dtype=float)))
    for a in range(int(low[axis]), int(high[axis]) + 1, thick):
        first, last = low.copy(), high.copy()
        first[axis], last[axis] = a, min(a + thick - 1, int(high[axis]))
        mine = np.flatnonzero((rank[:, axis] >= a) & (rank[:, axis] <= last[axis]))
        if not len(mine):
            continue
        held = (lo[:, axis] <= last[axis]) & (hi[:, axis] >= a)
        begin, end = np.maximum(lo[held], first) - first, np.minimum(hi[held], last) + 1 - first
        shape = last - first + 1
        table = np.zeros(np.prod(shape), np.int64)
        steps = np.r_[np.cumprod(shape[::-1].astype(np.int64))[-2::-1], 1]
        for corner in np.ndindex(*[2] * len(shape)):
            side = np.where(np.array(corner, bool)[None], end, begin)
            inside = (side < shape).all(axis=1)
            value = number[held][inside]
            np.add.at(table, side[inside] @ steps, -value if sum(corner) % 2 else value)
        table = table.reshape(shape)
        for k in range(len(shape)):
            np.cumsum(table, axis=k, out=table)
        out[mine] = table.ravel()[(rank[mine] - first) @ steps]
    return out


def block_sums(x: np.ndarray, ends: np.ndarray, f: np.ndarray, number: np.ndarray, left: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Sum over the trees of the leaf value that each row of ``x`` comes to; ``ends``: where blocks of rows that lie
    near each other end."""
    inner = f >= 0
    used = np.unique(f[inner])
    values = number[~inner]
    if not len(used) or not np.isfinite(values).all():
        return forest_sums(x, f, number, left, roots)
    column = np.zeros(int(used[-1]) + 1, np.int64)
    column[used] = np.arange(len(used))
    rank, q = np.empty((len(x), len(used)), np.int32), np.zeros(len(f), np.int32)
    for i, c in enumerate(used):
        own = np.flatnonzero(f == c)
        cuts, q[own] = np.unique(number[own], return_inverse=True)
        rank[:, i] = np.where(np.isnan(x[:, c]), 0, np.searchsorted(cuts, x[:, c]))
    # whole numbers add up exactly in any order; as fine as doubles of the greatest sum
    scale = 2.0 ** (61 - np.ceil(np.log2(len(roots) * max(np.abs(values).max(), 1e-300))))
    if not np.isfinite(scale) or scale == 0.0:
        return forest_sums(x, f, number, left, roots)
    whole = np.where(inner, 0.0, number)
    whole = np.rint(whole * scale).astype(np.int64)
    out, walked = np.zeros(len(x)), []
    for a, b in zip(np.r_[0, ends[:-1]], ends):
        if a == b:
            continue
        low, high = rank[a:b].min(axis=0), rank[a:b].max(axis=0)
        size = (high - low + 1).astype(float)
        if size.prod() / size.max() > CELLS or size.prod() * CELL + len(f) * NODE > (b - a) * len(roots) * WALK:
            walked.append(np.arange(a, b))
            continue
        nodes, lo, hi = _leaves(f, q, left, roots, column, low, high)
        out[a:b] = _by_cells(rank[a:b], lo, hi, whole[nodes], low, high) / scale
    if walked:
        rows = np.concatenate(walked)
        out[rows] = forest_sums(x[rows], f, number, left, roots)
    return out


def _sliced(x: DataFrame, p: list[str], many: int) -> tuple[DataFrame, list[str]]:
    """``x`` with its slice along each of the first predictors within those before it: about ``many`` blocks of points
    near each other for each field."""
    names, p = [], p[:3]
    m = min(64, int(np.ceil(many ** (1 / max(1, len(p))))))
    if m < 2:
        return x, names
    for i, c in enumerate(p):
        ends = x.groupBy("codigo", *names).agg(F.percentile_approx(F.col(c).cast("double"), [k / m for k in range(1, m)], 1000).alias("_q"))
        x = join_small(x, ends, ["codigo", *names])
        x = x.withColumn(f"_s{i}", F.coalesce(F.size(F.filter("_q", lambda e: e < F.col(c))), F.lit(0))).drop("_q")  # noqa: B023
        names.append(f"_s{i}")
    return x, names


def point_values(x: DataFrame, nodes: DataFrame, variables: list[str], p: list[str], null_right: bool = False, near: bool = False) -> DataFrame:
    """codigo, pid, v: means over the trees of each of ``variables`` (null: its field has none) for the rows of ``x``
    (codigo, pid, p).  A missing predictor goes left, with ``null_right`` right.  Rows of equal codigo and pid are one,
    their mean, unless points are sent with those ``near`` them among the predictors (where pid has to be unique).

    A task holds a run of points while the trees of their field pass by."""
    spark, kinds = x.sparkSession, dict(x.dtypes)
    x = x.select("codigo", "pid", *p)
    place = F.pmod(F.xxhash64("pid"), F.lit(1 << 30)) / (1 << 30)
    trees = cut_lineage(_packed_trees(nodes))
    counts = cut_lineage(x.groupBy("codigo").agg(F.count(F.lit(1)).alias("n")).join(trees.select("codigo").distinct(), "codigo"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = min(RUN, max(SMALL, -(-total // (3 * parallelism(spark)))))
    slices = []
    if near:
        cuts = nodes.filter("f IS NOT NULL").groupBy(*_GROUP, "f").agg(F.approx_count_distinct("threshold").alias("n"))
        cells = cuts.groupBy(*_GROUP).agg(F.sum(F.log2(F.col("n") + 1)).alias("n")).agg(F.max("n")).first()[0] or 0.0
        x, slices = _sliced(x, p, int(min(2.0 ** min(cells, 60.0) / CELLS, total / SMALL, 4096)))
    if slices:
        sizes = cut_lineage(x.groupBy("codigo", *slices).agg(F.count(F.lit(1)).alias("n")).join(counts.select("codigo"), "codigo"))
        before = F.sum("n").over(Window.partitionBy("codigo").orderBy(*slices)) - F.col("n")
        own = sizes.withColumns({"before": before, "block": F.row_number().over(Window.partitionBy("codigo").orderBy(*slices))})
        x = join_small(x, own.select("codigo", *slices, "n", "before", "block"), ["codigo", *slices])
        run, block = F.floor((F.col("before") + place * F.col("n")) / size), F.col("block").cast("int")
    else:
        x = join_small(x, counts.withColumn("runs", F.ceil(F.col("n") / size)), "codigo")
        run, block = F.floor(place * F.col("runs")), F.lit(0)
    runs = counts.select("codigo", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))).alias("run"))
    points = x.select("codigo", run.cast("int").alias("run"), F.lit(0).alias("kind"), block.alias("part"), "pid", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(p)])
    sent = join_small(trees, runs, "codigo").select("codigo", "run", F.lit(1).alias("kind"), F.col("chunk").alias("part"), "variable", "f", "number", "left", "roots")
    n = max(parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * runs.count())
    both = points.unionByName(sent, allowMissingColumns=True).repartition(n, "codigo", "run").sortWithinPartitions("codigo", "run", "kind", "variable", "part")
    names, types = both.columns, (("f", np.int16), ("number", np.float64), ("left", np.int32), ("roots", np.int32))
    wide = [f"x{i}" for i in range(len(p))]

    def evaluated(state, variable, held):
        """Adds the trees held of a variable to the points of the run."""
        sizes = np.cumsum([0, *(len(h[0]) for h in held)])
        f, number = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        left = np.concatenate([np.where(h[2] >= 0, h[2] + s, -1) for h, s in zip(held, sizes)])
        roots = np.concatenate([h[3] + s for h, s in zip(held, sizes)])
        sums, trees = state["sums"].setdefault(variable, (np.zeros(len(state["x"])), [0]))
        sums += block_sums(state["x"], state["ends"], f, number, left, roots)
        trees[0] += len(roots)

    def finished(state):
        pid, n = state["pid"], len(state["pid"])
        found = [state["sums"].get(v) for v in variables]
        found = [None if s is None else s[0] / s[1][0] for s in found]
        if not near and len(pc.unique(pid)) < n:
            keys = pid.dictionary_encode("encode")
            code, pid = keys.indices.to_numpy(), keys.dictionary
            many = np.bincount(code, minlength=len(pid))
            found, n = [None if v is None else np.bincount(code, v, len(pid)) / many for v in found], len(pid)
        for a in range(0, n, 1 << 16):
            z = slice(a, min(a + (1 << 16), n))
            rows = z.stop - a
            flat = np.stack([np.zeros(rows) if v is None else v[z] for v in found], 1).ravel()
            gaps = np.tile([v is None for v in found], rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, max(1, len(found)), dtype=np.int32)), pa.array(flat, mask=gaps))
            yield pa.RecordBatch.from_arrays([pa.array([state["codigo"]] * rows, state["kind"]), pid[a:z.stop], lists], names=["codigo", "pid", "v"])

    def run_(batches):
        key = state = variable = None
        held, seen = [], []

        def gathered():
            t = pa.Table.from_batches(seen)
            order = t["part"].to_numpy()
            data = np.stack([t[c].to_numpy() for c in wide], 1) if wide else np.zeros((len(t), 0))
            if null_right:
                data = np.where(np.isnan(data), np.inf, data)
            ends = np.r_[np.flatnonzero(order[1:] != order[:-1]) + 1, len(t)]
            return {"codigo": key[0], "kind": t.schema.field("codigo").type, "pid": t["pid"].combine_chunks(), "x": data, "ends": ends, "sums": {}}

        for rb in batches:
            codigo, runs_, kind = (rb.column(names.index(c)) for c in ("codigo", "run", "kind"))
            codes = np.unique(codigo.dictionary_encode().indices.to_numpy().astype(np.int64) * (1 << 31) + runs_.to_numpy(), return_index=True)[1] if len(rb) else []
            edges = np.unique(np.r_[np.sort(codes), np.flatnonzero(np.diff(kind.to_numpy())) + 1, len(rb)]).astype(int) if len(rb) else []
            for a, b in zip(edges, edges[1:]):
                now = (codigo[int(a)].as_py(), runs_[int(a)].as_py())
                if now != key:
                    if held:
                        evaluated(state, variable, held)
                    if state is not None and state["sums"]:
                        yield from finished(state)
                    key, state, variable, held, seen = now, None, None, [], []
                piece = rb.slice(a, b - a)
                if kind[int(a)].as_py() == 0:
                    seen.append(piece.select(["codigo", "part", "pid", *wide]))
                    continue
                if not seen and state is None:
                    continue  # trees of a run without points
                if state is None:
                    state, seen = gathered(), []
                for k in range(len(piece)):
                    v = piece.column(names.index("variable"))[k].as_py()
                    arrays = [np.frombuffer(piece.column(names.index(c))[k].as_buffer(), t).copy() for c, t in types]
                    if held and (v != variable or sum(len(h[0]) for h in held) + len(arrays[0]) > HELD):
                        evaluated(state, variable, held)
                        held = []
                    variable = v
                    held.append(arrays)
        if held:
            evaluated(state, variable, held)
        if state is not None and state["sums"]:
            yield from finished(state)

    return both.mapInArrow(run_, f"codigo {kinds['codigo']}, pid {kinds['pid']}, v array<double>")


def predict(grid: DataFrame, forests: FieldForests) -> DataFrame:
    """M8: codigo, pid, variable, value for every point of ``grid`` (codigo, pid, predictors) and every
    variable that its field has a forest for."""
    p = forests.predictors
    x = impute_mean(coerce_numeric(grid.select("codigo", "pid", *p), p), p, ("codigo",))
    variables = sorted(r[0] for r in forests.importances.select("variable").distinct().collect())  # some names
    out = point_values(x, forests.nodes, variables, p)
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(v) for v in variables]).alias("variable"), F.col("v").alias("value")))
    return out.select("codigo", "pid", pairs.alias("o")).select("codigo", "pid", "o.variable", "o.value").filter("value IS NOT NULL")
