"""Variogram and ordinary kriging.

* M9: the empirical semivariogram (Matheron: mean of half squared differences per lag
  bin) is an aggregate over the pair table of a bucketed distance-band join up to the
  cutoff, keyed by (field, variable).  The spherical model is fitted per (field,
  variable) on the binned result - a handful of rows per group - with NumPy.
* M10: the covariance of the spherical model is zero beyond its range, so the kriging
  system of a (field, variable) is sparse.  Its entries are an edge table (the same
  distance-band join, on a lattice of each group's own range), and C u = z, C v = 1 are
  solved for all groups together by conjugate gradients, a join and a partial aggregate a
  round; groups of at most ``LOCAL_NODES`` data are solved densely, each in a task.  With m = sum(u) / sum(v) and b = u - m v, the value anywhere is m + sum(b C(d)) over
  the data in range: no tile, no halo, no dense matrix, and a value for every target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldzones.functions.numeric import distance
from fieldzones.operators.moran import neighbour_pairs
from fieldzones.session import cut_lineage, dealt, join_small

#: Nodes of a system that is solved at once in one task (a dense matrix of 72 MB).
LOCAL_NODES = 3_000


def spherical(h, nugget, psill, rng):
    h = np.asarray(h, dtype=float)
    r = np.where(h < rng, psill * (1.5 * h / rng - 0.5 * (h / rng) ** 3) + nugget, psill + nugget)
    return np.where(h == 0, 0.0, r)


def variogram(points: DataFrame, max_dist: float = 100.0, n_lags: int = 6,
              keys=("codigo", "variable")) -> DataFrame:
    """M9 (empirical): ``keys, lag_bin, lag (mean distance), gamma, n_pairs``.

    ``points``: keys, pid, x, y, value.  Pairs are unordered (each counted once).
    """
    keys = list(keys)
    pairs = neighbour_pairs(points, max_dist, keys, "pid", carry=("value",))
    pairs = pairs.filter(F.col("i") < F.col("j"))
    width = max_dist / n_lags
    b = F.least(F.floor(F.col("d") / width).cast("int"), F.lit(n_lags - 1))
    dz = F.col("value_i") - F.col("value_j")
    return (pairs.withColumn("lag_bin", b).groupBy(*keys, "lag_bin")
            .agg(F.avg("d").alias("lag"), F.avg(0.5 * dz * dz).alias("gamma"),
                 F.count(F.lit(1)).alias("n_pairs")))


def fit_spherical(bins: DataFrame, keys=("codigo", "variable")) -> DataFrame:
    """M9 (model): least-squares spherical fit per group: ``nugget, psill, range``.

    For a fixed range the model is linear in (nugget, partial sill), so the range is
    searched on a grid and the two linear terms are solved exactly (kept non-negative).
    """
    keys = list(keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf["lag"].to_numpy(float)
        g = pdf["gamma"].to_numpy(float)
        best = (np.inf, 0.0, float(np.nanmax(g)) if len(g) else 0.0, float(h.max()) if len(h) else 1.0)
        if len(h) >= 2:
            for rng in np.linspace(h.min() * 0.5, h.max() * 3.0, 200):
                s = np.where(h < rng, 1.5 * h / rng - 0.5 * (h / rng) ** 3, 1.0)
                a = np.column_stack([np.ones_like(h), s])
                coef, *_ = np.linalg.lstsq(a, g, rcond=None)
                if coef[0] < 0:
                    coef = np.array([0.0, max(float(s @ g / (s @ s)), 0.0)])
                if coef[1] < 0:
                    coef = np.array([max(float(g.mean()), 0.0), 0.0])
                sse = float(((a @ coef - g) ** 2).sum())
                if sse < best[0]:
                    best = (sse, float(coef[0]), float(coef[1]), float(rng))
        row = {k: pdf[k].iloc[0] for k in keys}
        row.update(nugget=best[1], psill=best[2], range=best[3])
        return pd.DataFrame([row])

    schema = ", ".join(f"{k} string" for k in keys) + ", nugget double, psill double, range double"
    return bins.groupBy(*keys).applyInPandas(fit, schema)


def _covariance(d):
    """C(d) of the columns psill, range and c0 (the covariance of a datum with itself)."""
    h = d / F.col("range")
    near = F.col("psill") * (1.0 - 1.5 * h + 0.5 * h * h * h)
    return F.when(d == 0, F.col("c0")).when(d < F.col("range"), near).otherwise(0.0)


def _buckets(df: DataFrame, around: bool) -> DataFrame:
    """Lattice cell of each row on its group's range, or the 3 x 3 cells around it."""
    df = df.withColumns({"bx": F.floor(F.col("x") / F.col("range")), "by": F.floor(F.col("y") / F.col("range"))})
    if not around:
        return df
    offs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    df = df.withColumn("o", F.explode(offs))
    return df.withColumns({"bx": F.col("bx") + F.col("o.i"), "by": F.col("by") + F.col("o.j")}).drop("o")


def solve_groups(data: DataFrame, edges: DataFrame, keys: list[str], tol: float = 1e-9,
                 max_rounds: int = 1000) -> DataFrame:
    """``data`` (keys, node, c0, z) with the solutions ``u`` of C u = z and ``v`` of C v = 1 of each
    group, by conjugate gradients to a residual of ``tol`` times the right side; raises if that
    is not reached.  ``edges``: i, j, c of the entries off the diagonal."""
    state = data.withColumns({"u": F.lit(0.0), "ru": F.col("z"), "pu": F.col("z"),
                              "v": F.lit(0.0), "rv": F.lit(1.0), "pv": F.lit(1.0)})
    for _ in range(max_rounds):
        far = (edges.join(state.select(F.col("node").alias("j"), "pu", "pv"), "j").groupBy(F.col("i").alias("node"))
               .agg(F.sum(F.col("c") * F.col("pu")).alias("fu"), F.sum(F.col("c") * F.col("pv")).alias("fv")))
        q = lambda s: F.col("c0") * F.col(f"p{s}") + F.coalesce(F.col(f"f{s}"), F.lit(0.0))
        state = cut_lineage(state.join(far, "node", "left").withColumns({"qu": q("u"), "qv": q("v")}).drop("fu", "fv"))
        over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
        dots = state.groupBy(*keys).agg(*[x for s in "uv" for x in (
            F.sum(F.col(f"r{s}") * F.col(f"r{s}")).alias(f"rr{s}"), F.sum(F.col(f"p{s}") * F.col(f"q{s}")).alias(f"pq{s}"))])
        state = state.join(dots, keys).withColumns({f"a{s}": over(f"rr{s}", f"pq{s}") for s in "uv"})
        state = cut_lineage(state.withColumns({x: e for s in "uv" for x, e in (
            (s, F.col(s) + F.col(f"a{s}") * F.col(f"p{s}")), (f"r{s}", F.col(f"r{s}") - F.col(f"a{s}") * F.col(f"q{s}")))}))
        now = state.groupBy(*keys).agg(*[F.sum(F.col(f"r{s}") * F.col(f"r{s}")).alias(f"new{s}") for s in "uv"],
                                       F.sum(F.col("z") * F.col("z")).alias("zz"), F.count(F.lit(1)).alias("n"))
        state = state.join(now.drop("zz", "n"), keys).withColumns(
            {f"p{s}": F.col(f"r{s}") + over(f"new{s}", f"rr{s}") * F.col(f"p{s}") for s in "uv"})
        state = state.select(*data.columns, *[f"{x}{s}" for s in "uv" for x in ("", "r", "p")])
        left = now.agg(F.max(F.greatest(F.col("newu") - tol * tol * F.col("zz"), F.col("newv") - tol * tol * F.col("n")))).first()[0]
        if left is None or left <= 0:
            return state.select(*data.columns, "u", "v")
    raise RuntimeError("kriging systems did not converge")


def _solve_far(data: DataFrame, keys: list[str]) -> DataFrame:
    """The systems of ``data`` (keys, node, x, y, c0, z, psill, range) as edge tables, by conjugate gradients."""
    data = cut_lineage(data)
    here = _buckets(data.select(*keys, "node", "x", "y", "range", "psill", "c0"), False)
    there = _buckets(data.select(*keys, F.col("node").alias("j"), "x", "y", "range"), True).select(*keys, "j", F.col("x").alias("xj"), F.col("y").alias("yj"), "bx", "by")
    d = distance("x", "y", "xj", "yj")
    edges = here.join(there, [*keys, "bx", "by"]).filter((F.col("node") != F.col("j")) & (d < F.col("range")))
    edges = cut_lineage(edges.select(F.col("node").alias("i"), "j", _covariance(d).alias("c")).filter("c <> 0"))
    return solve_groups(data.select(*keys, "node", "x", "y", "c0", "z"), edges, keys)


def solve_local(data: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`solve_groups` for groups of at most ``LOCAL_NODES`` nodes (keys, node, x, y, c0, z, psill, range): each
    dense system is solved at once, all of them in one job."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        psill, c0, reach = (float(pdf[c].iloc[0]) for c in ("psill", "c0", "range"))
        h = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2) / reach
        c = np.where(h < 1.0, psill * (1.0 - 1.5 * h + 0.5 * h * h * h), 0.0)
        np.fill_diagonal(c, c0)
        right = np.column_stack([pdf["z"].to_numpy(float), np.ones(len(pdf))])
        try:
            found = np.linalg.solve(c, right)
        except np.linalg.LinAlgError:
            found = np.linalg.lstsq(c, right, rcond=None)[0]
        return pdf[[*keys, "node", "x", "y", "c0", "z"]].assign(u=found[:, 0], v=found[:, 1])

    kinds = dict(data.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "node", "x", "y", "c0", "z"]) + ", u double, v double"
    return dealt(data, *keys).groupBy(*keys).applyInPandas(run, schema)


def krige(points: DataFrame, targets: DataFrame, model: DataFrame,
          keys=("codigo", "variable")) -> DataFrame:
    """Ordinary kriging of ``points`` (keys, x, y, value) at ``targets`` (codigo, tid, x, y)
    with the per-group spherical ``model``: keys, tid, value, one row for every target and every
    variable that its field has data for.

    Data at one place are averaged.  Without a model (fewer than two data) or with a zero sill a
    group is its constant mean, and the datum itself at its own place.
    """
    keys = list(keys)
    data = points.filter(F.col("value").isNotNull()).groupBy(*keys, "x", "y").agg(F.avg("value").alias("value"))
    groups = data.groupBy(*keys).agg(F.avg("value").alias("mean")).join(model.select(*keys, "nugget", "psill", "range"), keys, "left")
    psill, sill = F.coalesce("psill", F.lit(0.0)), F.coalesce(F.col("psill") + F.col("nugget"), F.lit(0.0))
    groups = cut_lineage(groups.select(*keys, "mean", psill.alias("psill"), F.when(sill > 0, sill).otherwise(1.0).alias("c0"),
                                       F.when((psill > 0) & (F.col("range") > 0), F.col("range")).otherwise(1.0).alias("range")))
    data = data.join(groups, keys).withColumn("z", F.col("value") - F.col("mean"))
    data = cut_lineage(data.withColumn("node", F.monotonically_increasing_id()))
    sizes = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes"))
    few = cut_lineage(sizes.filter(F.col("nodes") <= LOCAL_NODES).select(*keys))
    solved = solve_local(join_small(data.select(*keys, "node", "x", "y", "c0", "z", "psill", "range"), few, keys, "left_semi"), keys)
    if not sizes.filter(F.col("nodes") > LOCAL_NODES).isEmpty():
        solved = solved.unionByName(_solve_far(join_small(data, few, keys, "left_anti"), keys))
    solved = cut_lineage(solved)
    middle = solved.groupBy(*keys).agg((F.sum("u") / F.sum("v")).alias("m"))
    groups = cut_lineage(groups.join(middle, keys))
    weights = solved.join(groups.select(*keys, "m", "range"), keys).withColumn("b", F.col("u") - F.col("m") * F.col("v"))
    weights = _buckets(weights.select(*keys, "x", "y", "b", "range"), True).select(*keys, F.col("x").alias("xj"), F.col("y").alias("yj"), "b", "bx", "by")
    wanted = _buckets(join_small(targets.select("codigo", "tid", "x", "y"), groups, "codigo"), False)
    reach = wanted.join(weights, [*keys, "bx", "by"], "left")
    d = distance("x", "y", "xj", "yj")
    out = reach.groupBy(*keys, "tid").agg((F.first(F.col("mean") + F.col("m")) + F.coalesce(F.sum(F.col("b") * _covariance(d)), F.lit(0.0))).alias("value"))
    return out.select(*keys, "tid", "value")
