"""Distance-band neighbours, Moran's I and its permutation test.

A plain ``distance <= r`` join plans as a nested loop.  Instead both sides are bucketed on
an r x r lattice; one side is exploded over the 3 x 3 surrounding buckets and the pair is
an equi-join on ``(codigo, bx, by)`` followed by the exact distance filter.  Every bucket
holds a bounded number of points, so a large field spreads over many join keys.

The permutation test deals the values of a field anew over its places, ``permutations`` times: in
permutation k the place of a value is its rank by ``md5(seed:k:field:pid)``, so any engine draws
the same ones.  The sums over neighbours are matrix products: tiles of ``TILE`` radii, with the points
up to one radius around them, times the values of ``CHUNK`` permutations.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldzones.functions.numeric import distance
from fieldzones.session import cut_lineage, dealt, join_small, parallelism

#: Edge of a tile in radii, permutations of one matrix product, rows of it at a time.
TILE, CHUNK, ROWS = 5, 125, 512
#: Points of a field whose permutations are ranked inside tasks, numbers that a run of permutations makes.
LOCAL_POINTS, VALUES = 1_000_000, 1 << 22
#: A permuted I this close to the observed one counts as equal to it (sums differ in the last bits).
SAME = 1e-9


def neighbour_pairs(df: DataFrame, radius: float = 50.0, keys=("codigo",), pid="pid",
                    carry=()) -> DataFrame:
    """Directed pairs (i, j), i != j, with distance <= radius (inclusive).

    ``carry`` columns travel with both ends as ``{c}_i`` and ``{c}_j``.
    """
    keys = list(keys)
    b = df.select(*keys, F.col(pid).alias("i"), "x", "y", *[F.col(c).alias(f"{c}_i") for c in carry],
                  F.floor(F.col("x") / radius).alias("bx"), F.floor(F.col("y") / radius).alias("by"))
    offs = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                     for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    probe = b.select(*keys, F.col("i").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"),
                     *[F.col(f"{c}_i").alias(f"{c}_j") for c in carry],
                     F.explode(offs).alias("o"), "bx", "by")
    probe = probe.select(*keys, "j", "xj", "yj", *[f"{c}_j" for c in carry],
                         (F.col("bx") + F.col("o.dx")).alias("bx"), (F.col("by") + F.col("o.dy")).alias("by"))
    pairs = b.join(probe, [*keys, "bx", "by"], "inner")
    d = distance("x", "y", "xj", "yj")
    return (pairs.filter((F.col("i") != F.col("j")) & (d <= F.lit(float(radius))))
            .select(*keys, "i", "j", d.alias("d"), *[f"{c}_i" for c in carry], *[f"{c}_j" for c in carry]))


def neighbour_histogram(df: DataFrame, pairs: DataFrame, keys=("codigo",), pid="pid") -> DataFrame:
    """Number of points with k neighbours, islands (k = 0) included, per field."""
    keys = list(keys)
    deg = pairs.groupBy(*keys, "i").agg(F.count(F.lit(1)).alias("k"))
    pts = df.select(*keys, F.col(pid).alias("i"))
    allk = pts.join(deg, [*keys, "i"], "left").fillna(0, subset=["k"])
    return allk.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n_points"))


def upper_tail(z) -> F.Column:
    """1 - Phi(|z|) as a column expression (Abramowitz and Stegun 7.1.26, error < 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741
                                                       + t * (-1.453152027 + t * 1.061405429))))
    return 0.5 * poly * F.exp(-x * x)


def morans_i(df: DataFrame, cols: list[str], radius: float = 50.0, row_standardised: bool = True,
             keys=("codigo",), pid="pid") -> DataFrame:
    """M4: Moran's I of each column on distance-band weights, per field.

    ``I = n / S0 * sum_ij w_ij z_i z_j / sum_i z_i^2`` with ``z`` centred in the field;
    weights binary or row-standardised (1 / degree).  Expectation ``-1/(n-1)`` and the
    normality-assumption variance (Cliff and Ord 1981) give ``z_norm`` and a one-sided
    ``p_norm``.  Everything is an aggregate over the edge table.
    """
    keys = list(keys)
    pairs = neighbour_pairs(df, radius, keys, pid)
    deg = pairs.groupBy(*keys, "i").agg(F.count(F.lit(1)).alias("deg"))
    means = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"_m{c}") for c in cols])
    pts = (df.select(*keys, F.col(pid).alias("i"), *cols).join(means, keys)
           .join(deg, [*keys, "i"], "left").fillna(0, subset=["deg"]))
    pts = pts.select(*keys, "i", "n", "deg", *[(F.col(c) - F.col(f"_m{c}")).alias(c) for c in cols])
    zj = pts.select(*keys, F.col("i").alias("j"), F.col("deg").alias("deg_j"),
                    *[F.col(c).alias(f"_j{c}") for c in cols])
    zi = pts.select(*keys, "i", "deg", *cols)
    e = pairs.join(zi, [*keys, "i"]).join(zj, [*keys, "j"])
    if row_standardised:
        w_ij, w_ji = 1.0 / F.col("deg"), 1.0 / F.col("deg_j")
    else:
        w_ij = w_ji = F.lit(1.0)
    edge_aggs = [F.sum(w_ij).alias("S0"), (F.sum((w_ij + w_ji) * (w_ij + w_ji)) / 2.0).alias("S1")]
    edge_aggs += [F.sum(w_ij * F.col(c) * F.col(f"_j{c}")).alias(f"_c{c}") for c in cols]
    ea = e.groupBy(*keys).agg(*edge_aggs)
    # S2 = sum_i (w_i. + w_.i)^2; incoming weights per node from the edge table
    inc = e.groupBy(*keys, F.col("j").alias("i")).agg(F.sum(w_ij).alias("win"))
    outw = F.when(F.col("deg") > 0, F.lit(1.0) if row_standardised else F.col("deg").cast("double")) \
        .otherwise(F.lit(0.0))
    node = pts.join(inc, [*keys, "i"], "left").fillna(0.0, subset=["win"])
    na = node.groupBy(*keys).agg(F.first("n").alias("n"),
                                 F.sum((outw + F.col("win")) * (outw + F.col("win"))).alias("S2"),
                                 *[F.sum(F.col(c) * F.col(c)).alias(f"_q{c}") for c in cols])
    s = na.join(ea, keys, "left")
    n, s0, s1, s2 = F.col("n").cast("double"), F.col("S0"), F.col("S1"), F.col("S2")
    ei = -1.0 / (n - 1.0)
    v = (n * n * s1 - n * s2 + 3.0 * s0 * s0) / ((n * n - 1.0) * s0 * s0) - ei * ei
    per_col = []
    for c in cols:
        i_val = (n / s0) * F.col(f"_c{c}") / F.col(f"_q{c}")
        per_col.append(F.struct(F.lit(c).alias("variable"), i_val.alias("I"),
                                ((i_val - ei) / F.sqrt(v)).alias("z_norm")))
    out = s.select(*keys, "n", ei.alias("EI"), F.explode(F.array(*per_col)).alias("r"))
    out = out.select(*keys, "r.variable", "r.I", "EI", "r.z_norm", "n")
    return out.withColumn("p_norm", upper_tail(F.col("z_norm")))


def permuted_values(points: DataFrame, cols: list[str], permutations: int, seed: int, keys: list[str]) -> DataFrame:
    """keys, place, chunk, ks, and for each column the values at the place in permutations ``ks`` of
    the chunk; permutation 0 is the observed one.  ``points``: keys, pid, place (1..n), n, cols.

    A field of at most ``LOCAL_POINTS`` meets runs of permutations, each ranked inside one task; a larger
    one is ranked by sorts that spill, those of one permutation in one task."""
    large = points.filter(F.col("n") > LOCAL_POINTS)
    values = _dealt_in_tasks(points.filter(F.col("n") <= LOCAL_POINTS), cols, permutations, seed, keys)
    return values if large.isEmpty() else values.unionByName(_dealt_by_sorts(large, cols, permutations, seed, keys))


def _dealt_in_tasks(points: DataFrame, cols: list[str], permutations: int, seed: int, keys: list[str]) -> DataFrame:
    """``permuted_values`` of fields of at most ``LOCAL_POINTS``: a run's values take at most VALUES numbers."""
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in keys], F.col("pid").cast("string")).alias("name")
    packed = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", name, *[F.col(c).cast("double").alias(c) for c in cols]))).alias("r"))
    width = F.greatest(F.lit(1), F.least(F.lit(CHUNK), F.floor(F.lit(VALUES // len(cols)) / F.size("r")))).cast("int")
    packed = cut_lineage(packed.select(*keys, width.alias("width"), *[F.col(f"r.{c}").alias(c) for c in ("place", "name", *cols)]))
    # a run a partition: the arrays of several would go to Python as one batch
    runs = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(permutations), F.col("width"))).alias("first"))
    spark = points.sparkSession
    n = max(parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")), packed.select(F.size(F.sequence(F.lit(0), F.lit(permutations), F.col("width"))).alias("c")).agg(F.sum("c")).first()[0] or 0)
    runs = runs.repartition(n, *keys, "first")
    names, kinds = runs.columns, dict(points.dtypes)

    def run(batches):
        for rb in batches:
            for i in range(len(rb)):
                v = {c: rb.column(j)[i] for j, c in enumerate(names)}
                first, width = v["first"].as_py(), v["width"].as_py()
                ids = [b":" + t.encode() for t in v["name"].values.to_pylist()]
                ks, n = range(first, min(first + width, permutations + 1)), len(ids)
                order = np.empty((n, len(ks)), np.int64)
                for j, k in enumerate(ks):
                    head = hashlib.md5(f"{seed}:{k}".encode())
                    draws = bytearray()
                    for t in ids:
                        h = head.copy()
                        h.update(t)
                        draws += h.digest()
                    draw = np.frombuffer(draws, ">u8").reshape(n, 2).astype(np.uint64)
                    order[:, j] = np.arange(n) if k == 0 else np.lexsort((draw[:, 1], draw[:, 0]))
                ends = pa.array(np.arange(n + 1) * len(ks), pa.int32())
                values = [pa.ListArray.from_arrays(ends, pa.array(v[c].values.to_numpy()[order].ravel())) for c in cols]
                each = [pa.array([v[c].as_py()] * n, rb.schema.field(c).type) for c in keys]
                out = pa.RecordBatch.from_arrays([*each, v["place"].values, pa.array(np.full(n, first), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(np.tile(np.array(ks, np.int32), n))), *values],
                                                 names=[*keys, "place", "chunk", "ks", *cols])
                yield from (out.slice(at, 1 << 14) for at in range(0, n, 1 << 14))

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", place int, chunk int, ks array<int>, " + ", ".join(f"{c} array<double>" for c in cols)
    return runs.mapInArrow(run, schema)


def _dealt_by_sorts(points: DataFrame, cols: list[str], permutations: int, seed: int, keys: list[str]) -> DataFrame:
    """``permuted_values`` of fields of any size, by a window over each permutation's rows."""
    k = F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("k")
    dealt = points.select(*keys, "pid", k, *cols)
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("k").cast("string"), *[F.col(c).cast("string") for c in keys], F.col("pid").cast("string")).cast("binary"))
    rank = F.row_number().over(Window.partitionBy(*keys, "k").orderBy("draw", "pid"))
    dealt = dealt.withColumn("draw", draw).withColumn("place", rank).select(*keys, "place", "k", *cols)
    dealt = dealt.unionByName(points.select(*keys, "place", F.lit(0).alias("k"), *cols))
    rows = dealt.groupBy(*keys, "place", F.floor(F.col("k") / CHUNK).cast("int").alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("k", *cols))).alias("r"))
    return rows.select(*keys, "place", "chunk", F.col("r.k").alias("ks"), *[F.col(f"r.{c}").alias(c) for c in cols])


def _tile_sums(cols: list[str], keys: list[str], radius: float, row_standardised: bool):
    """Group function of one tile and chunk: sums over the tile's own points of z_i * sum_j w_ij z_j."""
    def run(t: pa.Table) -> pa.Table:
        x, y, own = (t[c].to_numpy() for c in ("x", "y", "own"))
        ks = t["ks"][0].as_py()
        z = {c: t[c].combine_chunks().flatten().to_numpy().reshape(len(x), len(ks)) for c in cols}
        total, weight = {c: np.zeros(len(ks)) for c in cols}, 0.0
        for at in np.array_split(np.flatnonzero(own), max(1, -(-int(own.sum()) // ROWS))):
            dx, dy = x[at, None] - x[None], y[at, None] - y[None]
            w = (np.sqrt(dx * dx + dy * dy) <= radius).astype(float)
            w[np.arange(len(at)), at] = 0.0
            degree = w.sum(axis=1, keepdims=True)
            if row_standardised:
                w = np.divide(w, degree, out=w, where=degree > 0)
            weight += float(w.sum())
            for c in cols:
                total[c] += (z[c][at] * (w @ z[c])).sum(axis=0)
        n = len(cols)
        return pa.table([pa.array([t[k][0].as_py()] * n) for k in keys] + [pa.array(cols), pa.array([ks] * n, pa.list_(pa.int32())),
                        pa.array([total[c] for c in cols], pa.list_(pa.float64())), pa.array([weight] * n)], names=[*keys, "variable", "ks", "sums", "weight"])
    return run


def morans_i_permuted(df: DataFrame, cols: list[str], radius: float = 50.0, permutations: int = 999, seed: int = 42,
                      row_standardised: bool = True, keys=("codigo",), pid="pid") -> DataFrame:
    """M4: Moran's I with its permutation p-value: keys, variable, I, EI, n, n_extreme, p_sim.

    Rows with a null in ``cols`` are left out.  ``n_extreme`` is the number of permutations whose I is
    at least the observed one, or of the others if they are fewer; p = (n_extreme + 1) / (permutations + 1).
    A field without neighbours or without variance has a null I and p.
    """
    keys = list(keys)
    pts = df.select(*keys, F.col(pid).alias("pid"), "x", "y", *cols).na.drop(subset=["x", "y", *cols])
    mean = pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"_m{c}") for c in cols])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("pid", "x", "y"))
    pts = join_small(pts, mean, keys).select(*keys, "pid", "x", "y", "n", place.alias("place"), *[(F.col(c) - F.col(f"_m{c}")).alias(c) for c in cols])
    pts = cut_lineage(pts)
    edge = TILE * radius
    here = lambda v, d: F.floor((F.col(v) + d) / edge)
    # a point belongs to its own tile, and to those whose points it may neighbour
    tiles = F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(here("x", -radius), here("x", radius)), lambda a: F.transform(
        F.sequence(here("y", -radius), here("y", radius)), lambda b: F.struct(a.alias("tx"), b.alias("ty")))))))
    where = pts.select(*keys, "place", "x", "y", tiles.alias("t"), here("x", 0).alias("hx"), here("y", 0).alias("hy")).select(
        *keys, "place", "x", "y", "t.tx", "t.ty", ((F.col("t.tx") == F.col("hx")) & (F.col("t.ty") == F.col("hy"))).alias("own"))
    values = cut_lineage(permuted_values(pts, cols, permutations, seed, keys))
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", variable string, ks array<int>, sums array<double>, weight double"
    sums = (dealt(join_small(values, where, [*keys, "place"]), *keys, "tx", "ty", "chunk").groupBy(*keys, "tx", "ty", "chunk")
            .applyInArrow(_tile_sums(cols, keys, radius, row_standardised), schema))
    each = sums.select(*keys, "variable", "weight", F.explode(F.arrays_zip("ks", "sums")).alias("s"))
    each = each.groupBy(*keys, "variable", F.col("s.ks").alias("k")).agg(F.sum("s.sums").alias("total"), F.sum("weight").alias("weight"))
    squares = pts.groupBy(*keys).agg(F.max("n").alias("n"), *[F.sum(F.col(c) * F.col(c)).alias(c) for c in cols])
    squares = squares.select(*keys, "n", F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("square")) for c in cols])).alias("q"))
    each = join_small(each, squares.select(*keys, "n", "q.variable", "q.square"), [*keys, "variable"])
    value = F.when((F.col("weight") > 0) & (F.col("square") > 0), F.col("n") / F.col("weight") * F.col("total") / F.col("square"))
    each = cut_lineage(each.select(*keys, "variable", "n", "k", value.alias("I")))
    seen = each.where("k = 0").select(*keys, "variable", "n", F.col("I"))
    drawn = join_small(each.where("k > 0").select(*keys, "variable", F.col("I").alias("drawn")), seen, [*keys, "variable"])
    larger = F.count_if(F.col("drawn") >= F.col("I") - SAME)
    out = drawn.groupBy(*keys, "variable").agg(F.max("n").alias("n"), F.max("I").alias("I"), larger.alias("larger"))
    extreme = F.when(F.col("I").isNotNull(), F.least(F.col("larger"), F.lit(permutations) - F.col("larger")))
    return out.select(*keys, "variable", "I", (-1.0 / (F.col("n") - 1.0)).alias("EI"), "n", extreme.alias("n_extreme"), ((extreme + 1) / (permutations + 1.0)).alias("p_sim"))
