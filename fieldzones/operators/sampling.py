"""Soil-sampling design.

K-means runs for all fields at once with a different k per field.  Fields up to a bounded
size iterate inside one task each; larger fields run Lloyd rounds as partial aggregates
over the checkpointed grid in which blocks of points meet the centres of their field
(halved until few centres are left that may be nearest); only centres travel to the
driver between rounds.  Representatives are chosen with a
``min(struct(dist, pid))`` aggregate rather than a window, so a huge field is still
pre-aggregated on every partition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldzones.functions import geometry as geo
from fieldzones.functions.numeric import distance, round_even
from fieldzones.session import cut_lineage, dealt, join_small


def sampling_quota(fields: DataFrame, ha_per_point: float) -> DataFrame:
    """Z3: points per field = the sum over its polygons of round-half-even(area / ha_per_point);
    0 -> 1, flagged.  Without ``parts`` the field is one polygon of ``area_ha``."""
    if not ha_per_point > 0:
        raise ValueError("hectares per point must be greater than zero")
    points = lambda ha: round_even(ha / F.lit(float(ha_per_point)))
    if "parts" in fields.columns:
        q = F.aggregate("parts", F.lit(0.0), lambda n, p: n + points(geo.polygon_area(p) / 1e4))
    else:
        q = points(F.col("area_ha"))
    return fields.withColumn("n_puntos_raw", q.cast("int")).withColumn(
        "n_puntos", F.greatest(F.col("n_puntos_raw"), F.lit(1))).withColumn(
        "quota_raised", F.col("n_puntos_raw") < 1)


def _seed_centres(pts: DataFrame, quota: DataFrame, seed: int) -> DataFrame:
    """k distinct start points per field, the k smallest of a seeded hash.

    Candidates are pre-filtered to about 2k per field with a hash threshold, so the
    ranking window only ever sees a few rows per field; fields short of candidates
    retry with a larger threshold.
    """
    h = (F.pmod(F.xxhash64(F.lit(seed), F.col("pid")), F.lit(1 << 30)) / float(1 << 30))
    sizes = pts.groupBy("codigo").agg(F.count(F.lit(1)).alias("npts"))
    q = quota.select("codigo", "k").join(sizes, "codigo")
    q = q.withColumn("k", F.least("k", "npts"))
    hp = pts.withColumn("h", h)
    factor = 2.0
    while True:
        thr = F.least(F.lit(1.0), F.col("k") * factor / F.col("npts") + 16.0 / F.col("npts"))
        cand = join_small(hp, q.withColumn("thr", thr), "codigo").filter(F.col("h") <= F.col("thr"))
        w = Window.partitionBy("codigo").orderBy("h", "pid")
        ranked = cand.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= F.col("k"))
        short = ranked.groupBy("codigo", "k").agg(F.count(F.lit(1)).alias("got")) \
            .filter(F.col("got") < F.col("k"))
        if factor >= 1e9 or short.limit(1).count() == 0:
            break
        factor *= 4.0
    return ranked.groupBy("codigo").agg(
        F.sort_array(F.collect_list(F.struct("r", "x", "y"))).alias("s")) \
        .select("codigo", F.transform("s", lambda t: F.array(t["x"], t["y"])).alias("C"))


LOCAL_MAX_POINTS = 1_000_000
#: Points of one task of ``nearest_centre``; points of a leaf and centres met at once.
NEAREST_POINTS, LEAF, FEW = 200_000, 256, 16


def _nearest(xy: np.ndarray, cur: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre (first on ties) and its distance ``sqrt(dx*dx + dy*dy)``.

    The points are halved by their longer side; a half keeps the centres that may be nearest to a point of
    its bounding box (none farther than the least greatest distance to the box), until its points
    or its centres are few.  Distances are measured there, so the choice is the exact first minimum.
    """
    lab, dist = np.zeros(len(xy), np.int64), np.full(len(xy), np.nan)
    ok = np.flatnonzero(np.isfinite(cur).all(axis=1))
    _, first = np.unique(cur[ok], axis=0, return_index=True)
    known = np.isfinite(xy).all(axis=1)
    todo = [(np.flatnonzero(known), ok[np.sort(first)])]  # equal centres: the first
    if not len(ok):
        return lab, dist
    while todo:
        at, near = todo.pop()
        if not len(at):
            continue
        p, c = xy[at], cur[near]
        lo, hi = p.min(axis=0), p.max(axis=0)
        if len(near) > 1:
            far = np.maximum(np.abs(c - lo), np.abs(c - hi))
            gap = np.maximum(np.maximum(lo - c, c - hi), 0.0)
            reach = (far * far).sum(axis=1).min()
            keep = (gap * gap).sum(axis=1) <= reach * (1.0 + 1e-9) + 1e-9
            near, c = near[keep], c[keep]
        if len(at) <= LEAF or len(near) <= FEW or (lo == hi).all():
            for k in range(0, len(at), max(1, 1_000_000 // len(near))):
                rows = slice(k, k + max(1, 1_000_000 // len(near)))
                dx, dy = p[rows, 0:1] - c[None, :, 0], p[rows, 1:2] - c[None, :, 1]
                d = np.sqrt(dx * dx + dy * dy)
                best = d.argmin(axis=1)
                lab[at[rows]], dist[at[rows]] = near[best], d[np.arange(len(best)), best]
            continue
        side = int(hi[1] - lo[1] > hi[0] - lo[0])
        order = np.argpartition(p[:, side], len(at) // 2)
        todo += [(at[order[:len(at) // 2]], near), (at[order[len(at) // 2:]], near)]
    return lab, dist


def nearest_centre(points: DataFrame, centres: DataFrame) -> DataFrame:
    """``points`` (codigo, pid, x, y, ...) of the fields of ``centres`` (codigo, C: array of [x, y]) with
    the index of the nearest centre (first on ties) as ``cluster`` and the distance to it as ``dist``.

    Blocks of a field's points meet its centres; a task holds one block, not a field."""
    names, kinds = points.columns, dict(points.dtypes)
    place = F.pmod(F.xxhash64("pid", "x", "y"), F.lit(1 << 30)) / (1 << 30)
    sizes = cut_lineage(points.groupBy("codigo").agg(F.ceil(F.count(F.lit(1)) / NEAREST_POINTS).alias("blocks")).join(
        centres.select("codigo", "C"), "codigo"))
    blocked = join_small(points, sizes.select("codigo", "blocks"), "codigo").withColumn("block", F.floor(place * F.col("blocks")).cast("int"))
    sent = sizes.select("codigo", "C", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(names)
        xy = np.column_stack([left[c].cast(pa.float64()).to_numpy() for c in ("x", "y")])
        tables = []
        for c in right["C"].to_pylist() if len(left) else []:
            cur = np.array([[np.nan if v is None else v for v in p] for p in c], dtype=float).reshape(-1, 2)
            lab, d = _nearest(xy, cur)
            none = np.isnan(d)
            tables.append(left.append_column("cluster", pa.array(lab.astype(np.int32), mask=none)).append_column("dist", pa.array(d, mask=none)))
        return pa.concat_tables(tables) if tables else left.slice(0, 0).append_column("cluster", pa.array([], pa.int32())).append_column("dist", pa.array([], pa.float64()))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", cluster int, dist double"
    by = lambda df: dealt(df, "codigo", "block").groupBy("codigo", "block")
    return by(blocked).cogroup(by(sent)).applyInArrow(run, schema)


def _local_lloyd(max_iter: int, tol: float):
    """Lloyd iterations for one bounded field in NumPy (same rules as the distributed
    rounds: first centre on ties, an empty cluster keeps its centre, relative tolerance).
    Returns the final assignment of every point with its centre."""
    def run(pdf: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or seeds.empty:
            return pd.DataFrame(columns=["codigo", "pid", "x", "y", "cluster", "dist", "cx", "cy"])
        xy = pdf[["x", "y"]].to_numpy(float)
        cur = np.array([list(c) for c in seeds["C"].iloc[0]], dtype=float)
        var = float(((xy - xy.mean(0)) ** 2).mean(0).mean())
        k = len(cur)
        for _ in range(max_iter):
            lab, _d = _nearest(xy, cur)
            cnt = np.bincount(lab, minlength=k)
            sx = np.bincount(lab, weights=xy[:, 0], minlength=k)
            sy = np.bincount(lab, weights=xy[:, 1], minlength=k)
            upd = cur.copy()  # an empty cluster keeps its centre
            has = cnt > 0
            upd[has, 0] = sx[has] / cnt[has]
            upd[has, 1] = sy[has] / cnt[has]
            shift = float(((upd - cur) ** 2).sum())
            cur = upd
            if shift <= tol * var:
                break
        lab, d = _nearest(xy, cur)
        return pd.DataFrame({"codigo": pdf["codigo"].to_numpy(), "pid": pdf["pid"].to_numpy(),
                             "x": xy[:, 0], "y": xy[:, 1], "cluster": lab.astype("int32"), "dist": d,
                             "cx": cur[lab, 0], "cy": cur[lab, 1]})
    return run


def spatial_kmeans(points: DataFrame, quota: DataFrame, max_iter: int = 300,
                   tol: float = 1e-4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """M5: Lloyd's K-means on (x, y) per field with k = quota (``k`` column).

    A field has converged when the summed squared shift of its centres is at most
    ``tol`` times the mean variance of its coordinates (the usual relative tolerance).
    Fields of at most ``LOCAL_MAX_POINTS`` points iterate inside one task (bounded memory,
    one job for all of them); larger fields iterate as distributed rounds in which only
    centres travel to the driver.
    Returns ``(assigned points with cluster and dist, centres codigo/cluster/cx/cy)``.
    """
    spark: SparkSession = points.sparkSession
    schema = "codigo string, C array<array<double>>"
    pts = cut_lineage(points.select("codigo", "pid", "x", "y"))
    seeds = cut_lineage(_seed_centres(pts, quota, seed))
    sizes = (pts.groupBy("codigo").agg(F.count(F.lit(1)).alias("npts"))
             .join(quota.select("codigo", "k"), "codigo", "left").fillna(1, subset=["k"]))
    fits = F.col("npts") <= LOCAL_MAX_POINTS
    small = sizes.filter(fits).select("codigo")
    # the seeds travel once per field (cogroup), not once per point
    local = cut_lineage(
        join_small(pts, small, "codigo", "left_semi").groupBy("codigo")
        .cogroup(seeds.groupBy("codigo")).applyInPandas(
            _local_lloyd(max_iter, tol),
            "codigo string, pid long, x double, y double, cluster int, dist double, cx double, cy double"))
    big = sizes.filter(~fits).select("codigo")
    pts_big = join_small(pts, big, "codigo", "left_semi")
    var = {r[0]: (r[1] or 0.0) for r in pts_big.groupBy("codigo").agg(
        ((F.var_pop("x") + F.var_pop("y")) / 2.0).alias("v")).collect()}  # one number per field
    state = [tuple(r) for r in join_small(seeds, big, "codigo", "left_semi").collect()]
    rounds = 0
    final: list = []
    while state and rounds < max_iter:
        rounds += 1
        cdf = spark.createDataFrame(state, schema)
        a = nearest_centre(pts_big, cdf)
        agg = (a.groupBy("codigo", "cluster")
               .agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")).collect())
        new: dict = {}
        for r in agg:
            new.setdefault(r["codigo"], {})[r["cluster"]] = (r["cx"], r["cy"])
        nxt = []
        for code, cs in state:
            upd = [list(new.get(code, {}).get(i, c)) for i, c in enumerate(cs)]  # empty: keep
            shift = sum(((u[0] - c[0]) ** 2 + (u[1] - c[1]) ** 2) for u, c in zip(upd, cs))
            (final if shift <= tol * var.get(code, 0.0) else nxt).append((code, upd))
        state = nxt
    final += state
    cdf = spark.createDataFrame(final, schema)
    big_assigned = nearest_centre(pts_big, cdf)
    big_centres = cdf.select("codigo", F.posexplode("C").alias("cluster", "c")) \
        .select("codigo", "cluster", F.col("c")[0].alias("cx"), F.col("c")[1].alias("cy"))
    assigned = local.select("codigo", "pid", "x", "y", "cluster", "dist").unionByName(
        big_assigned.select("codigo", "pid", "x", "y", "cluster", "dist"))
    centres = local.select("codigo", "cluster", "cx", "cy").distinct().unionByName(big_centres)
    return assigned, centres


def representatives(assigned: DataFrame, centres: DataFrame) -> DataFrame:
    """Per cluster, the point nearest its centre (smallest pid on ties); empty skipped."""
    j = join_small(assigned.drop("dist"), centres, ["codigo", "cluster"])
    j = j.withColumn("dist", distance("x", "y", "cx", "cy"))
    best = j.groupBy("codigo", "cluster").agg(F.min(F.struct("dist", "pid", "x", "y")).alias("b"))
    return best.select("codigo", "cluster", "b.pid", "b.x", "b.y", "b.dist")


def number_samples(reps: DataFrame) -> DataFrame:
    """Sample number n = 1..N per field in cluster order (N = quota, small)."""
    w = Window.partitionBy("codigo").orderBy("cluster")
    return reps.withColumn("n", F.row_number().over(w))


def unpivot(df: DataFrame, cols: list[str], keys=("codigo",), name="index", value="value") -> DataFrame:
    """Wide layer columns -> (keys, index, value) rows (``stack``)."""
    arr = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])
    return df.select(*keys, F.explode(arr).alias("_s")).select(*keys, f"_s.{name}", f"_s.{value}")


def representativeness(total: DataFrame, sample: DataFrame, cols: list[str],
                       keys=("codigo",)) -> DataFrame:
    """Mean and sample std of population and sample, difference of means, for the
    indices present in both."""
    keys = list(keys)
    both = [c for c in cols if c in total.columns and c in sample.columns]

    def stats(df, tag):
        return unpivot(df, both, keys).groupBy(*keys, "index").agg(
            F.avg("value").alias(f"mean_{tag}"), F.stddev_samp("value").alias(f"std_{tag}"))

    j = stats(total, "total").join(stats(sample, "sample"), [*keys, "index"], "inner")
    return j.withColumn("diff_mean", F.col("mean_sample") - F.col("mean_total"))


def tag_and_union(total: DataFrame, sample: DataFrame, cols: list[str], keys=("codigo",)) -> DataFrame:
    """Population and sample values in one long table with a ``Dataset`` tag."""
    t = unpivot(total, cols, keys).withColumn("Dataset", F.lit("Total"))
    s = unpivot(sample, cols, keys).withColumn("Dataset", F.lit("Muestra"))
    return t.unionByName(s)


def density_histogram(long: DataFrame, keys=("codigo", "index")) -> DataFrame:
    """Density histograms of population and sample, empty bins included.

    Both sets use bins = min(50, int(sqrt(n))) with n the population count; each set's
    edges span its own min..max (the last bin is closed), widened by 0.5 on both sides for a
    constant set.  density = count / (n * width).
    """
    keys = list(keys)
    v = long.filter(F.col("value").isNotNull())
    rng = v.groupBy(*keys, "Dataset").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("nset"))
    npop = rng.filter(F.col("Dataset") == "Total").select(*keys, F.col("nset").alias("npop"))
    flat = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    st = (rng.join(npop, keys)
          .withColumn("bins", F.least(F.lit(50), F.floor(F.sqrt("npop")).cast("int")))
          .filter(F.col("bins") > 0)
          .select(*keys, "Dataset", "nset", "bins", (F.col("lo") - flat).alias("lo"), (F.col("hi") + flat).alias("hi"))
          .withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins")))
    st = cut_lineage(st)  # a row for each set: read twice below
    j = join_small(v, st, [*keys, "Dataset"])
    b = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")).cast("int"), F.col("bins") - 1)
    counts = j.withColumn("bin", b).groupBy(*keys, "Dataset", "bin").agg(F.count(F.lit(1)).alias("count"))
    every = st.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    c = every.join(counts, [*keys, "Dataset", "bin"], "left").fillna(0, subset=["count"])
    return c.select(*keys, "Dataset", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left"),
                    "count", (F.col("count") / (F.col("nset") * F.col("width"))).alias("density"))


#: Values whose kernels are held at once, and sets of a task before their sums are passed on.
KDE_VALUES, KDE_SETS = 2_000, 20_000


def kde_curve(long: DataFrame, n_points: int = 200, keys=("codigo", "index")) -> DataFrame:
    """Gaussian kernel density on ``n_points`` evaluation points over each set's range.

    Bandwidth by Scott's rule h = s * n^(-1/5).  Each value meets its set's parameters in one
    broadcast row; a task adds up the kernels of its values as arrays, one for each set it sees, so a hot
    set is summed on every partition and nothing is exploded before that.
    """
    keys = list(keys)
    v = long.filter(F.col("value").isNotNull())
    st = v.groupBy(*keys, "Dataset").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"),
        F.stddev_samp("value").alias("s"))
    st = st.withColumn("h", F.col("s") * F.pow(F.col("n"), F.lit(-0.2))).filter(F.col("h") > 0)
    st = cut_lineage(st.withColumn("set", F.monotonically_increasing_id()))  # a row for each set
    j = join_small(v.select(*keys, "Dataset", "value"), st, [*keys, "Dataset"]).select("set", "lo", "hi", "h", "value")
    steps = np.arange(n_points)

    def kernels(batches):
        held: dict = {}

        def out():
            rows = pa.array([x.tolist() for x in held.values()], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), rows], names=["set", "ks"])

        for rb in batches:
            which, lo, hi, h, value = (rb.column(c).to_numpy() for c in range(5))
            order = np.argsort(which, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(which[order])) + 1):
                for at in np.array_split(rows, -(-len(rows) // KDE_VALUES)) if len(rows) else []:
                    k = at[0]
                    z = (lo[k] + steps * (hi[k] - lo[k]) / (n_points - 1))[:, None] - value[at][None]
                    z /= h[k]
                    z *= z
                    z *= -0.5
                    total = np.exp(z, out=z).sum(axis=1)
                    held[int(which[k])] = held[int(which[k])] + total if int(which[k]) in held else total
            if len(held) > KDE_SETS:
                yield out()
                held.clear()
        if held:
            yield out()

    sums = j.mapInArrow(kernels, "set long, ks array<double>").select("set", F.posexplode("ks").alias("t", "k"))
    sums = sums.groupBy("set", "t").agg(F.sum("k").alias("ks"))
    out = sums.join(st, "set")
    at = F.col("lo") + F.col("t") * (F.col("hi") - F.col("lo")) / (n_points - 1)
    dens = F.col("ks") / (F.col("n") * F.col("h") * F.lit(2.5066282746310002))
    return out.select(*keys, "Dataset", "t", at.alias("at"), dens.alias("density"))


def box_summary(long: DataFrame, keys=("codigo", "index", "Dataset")) -> DataFrame:
    """Quartiles (linear), whiskers at the last values within 1.5 IQR, mean, outliers.

    Quartiles are exact order statistics (``exact_quantiles``), and no group is ever gathered
    whole into one task.
    """
    from fieldzones.operators.stats import exact_quantiles
    keys = list(keys)
    v = long.filter(F.col("value").isNotNull())
    qs = exact_quantiles(v, keys, [0.25, 0.5, 0.75])
    q = (qs.groupBy(*keys).pivot("p", [0.25, 0.5, 0.75]).agg(F.first("quantile"))
         .toDF(*keys, "q1", "median", "q3"))
    q = q.join(v.groupBy(*keys).agg(F.avg("value").alias("mean")), keys)
    q = q.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
        .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = join_small(v, q, keys)
    inside = (F.col("value") >= F.col("lo_fence")) & (F.col("value") <= F.col("hi_fence"))
    w = j.groupBy(*keys).agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.sum(F.when(~inside, 1).otherwise(0)).cast("long").alias("n_outliers"))
    return q.join(w, keys).select(*keys, "q1", "median", "q3", "mean", "whisker_lo", "whisker_hi",
                                  "n_outliers")
