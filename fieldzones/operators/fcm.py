"""Fuzzy C-means per field.

Groups (field, c) of at most ``LOCAL_MAX_POINTS`` points run the whole iteration inside
one task (``applyInPandas``, memory bounded by that limit): one job for all ordinary
fields.  Larger groups iterate as distributed rounds: memberships are a pure function of
the centres, so a round is one aggregate over the (checkpointed) points with the current
and the previous centres joined in as a small broadcast table; it yields the next centres
and the convergence measure ``||U_r - U_{r-1}||`` in the same pass.  Only centres travel to
the driver between rounds; converged groups drop out.  Both paths run the same algorithm
(same crisp seeded start, same stopping rule), and many values of c run in the same job
keyed by ``(codigo, c)``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldzones.functions.numeric import argmax
from fieldzones.session import cut_lineage, join_small

EPS = 2.220446049250313e-16  # float64 machine epsilon: distances are floored at it


def _memberships(cols: list[str], centres: str, m: float) -> F.Column:
    """u_k = d_k^(-2/(m-1)) / sum_j d_j^(-2/(m-1)) for the centres in column ``centres``."""
    p = -2.0 / (m - 1.0)

    def dist(ctr):
        s = None
        for i, c in enumerate(cols):
            d = F.col(c) - ctr[i]
            s = d * d if s is None else s + d * d
        return F.greatest(F.sqrt(s), F.lit(EPS))

    w = F.transform(F.col(centres), lambda ctr: F.pow(dist(ctr), p))
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    return F.transform(w, lambda x: x / total)


LOCAL_MAX_POINTS = 200_000


def _init_class(seed: int, init: str):
    """Crisp start class of a point: seeded hash (or pid) modulo the number of clusters."""
    if init == "mod":
        return F.pmod(F.col("pid"), F.col("n_clusters")).cast("int")
    return F.pmod(F.xxhash64(F.lit(seed), F.col("pid")), F.col("n_clusters")).cast("int")


def _local_fcm(cols, keys, m, error, maxiter):
    """The same iteration as the distributed rounds, for one bounded group in NumPy."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[cols].to_numpy(float)
        k0 = pdf["k0"].to_numpy()
        c = int(pdf["n_clusters"].iloc[0])
        # always c centres: an empty start class takes a class mean that is there
        have = [x[k0 == k].mean(0) for k in sorted(set(k0.tolist()))]
        own = dict(zip(sorted(set(k0.tolist())), have))
        cur = np.array([own.get(k, have[k % len(have)]) for k in range(c)])

        def memb(c):
            d = np.fmax(np.sqrt(((x[:, None, :] - c[None, :, :]) ** 2).sum(-1)), EPS)
            w = d ** (-2.0 / (m - 1.0))
            return w / w.sum(1, keepdims=True)

        u_prev, rounds = None, 0
        while rounds < maxiter - 1:
            rounds += 1
            u = memb(cur)
            if u_prev is not None and np.sqrt(((u - u_prev) ** 2).sum()) < error:
                break
            um = u ** m
            wsum = um.sum(0)
            nxt = np.where(wsum[:, None] > 0, (um.T @ x) / np.where(wsum > 0, wsum, 1.0)[:, None], cur)
            u_prev, cur = u, nxt
        row = {k: pdf[k].iloc[0] for k in keys}
        row.update(n_clusters=int(pdf["n_clusters"].iloc[0]), centres=cur.tolist(), rounds=rounds)
        return pd.DataFrame([row])
    return run


def _initial_centres(pts: DataFrame, cols: list[str], keys: list[str], seed: int,
                     init: str) -> DataFrame:
    """Centres from a crisp seeded partition: point -> class ``hash(seed, pid) mod c``."""
    g = pts.withColumn("k", _init_class(seed, init)).groupBy(*keys, "n_clusters", "k").agg(*[F.avg(x).alias(x) for x in cols])
    g = g.groupBy(*keys, "n_clusters").agg(F.sort_array(F.collect_list(F.struct("k", F.array(*cols).alias("v")))).alias("s"))
    # always c centres: an empty start class takes a class mean that is there
    own = lambda k: F.get(F.filter("s", lambda t: t["k"] == k), F.lit(0))["v"]
    centres = F.transform(F.sequence(F.lit(0), F.col("n_clusters") - 1),
                          lambda k: F.coalesce(own(k), F.get("s", k % F.size("s"))["v"]))
    return g.select(*keys, "n_clusters", centres.alias("cur"))


def fcm_round(pts: DataFrame, state: DataFrame, cols: list[str], keys: list[str], m: float) -> DataFrame:
    """One round: from (previous centres ``prev``, current ``cur``) to next centres and error.

    Memberships are computed once per point and exploded to one row per (point, k), so
    every sum below is a plain column aggregate.  Output: one row per (field, c, k).
    """
    j = pts.join(F.broadcast(state), [*keys, "n_clusters"])
    u = _memberships(cols, "cur", m)
    uo = F.when(F.col("prev").isNull(), F.array_repeat(F.lit(None).cast("double"), F.size("cur"))).otherwise(
        _memberships(cols, "prev", m))
    pairs = F.arrays_zip(u.alias("u"), uo.alias("uo"))
    e = j.select(*keys, "n_clusters", *cols, F.posexplode(pairs).alias("k", "z"))
    w = F.pow(F.col("z.u"), F.lit(m))
    d = F.col("z.u") - F.col("z.uo")
    return (e.groupBy(*keys, "n_clusters", "k")
            .agg(F.sum(d * d).alias("e2"), F.sum(w).alias("w"),
                 *[F.sum(w * F.col(x)).alias(f"s_{x}") for x in cols]))


def fuzzy_cmeans(df: DataFrame, cols: list[str], cs=(3,), m: float = 2.0, error: float = 0.005,
                 maxiter: int = 1000, seed: int = 42, keys=("codigo",), init: str = "hash"):
    """Fuzzy C-means for every field and every c in ``cs``.

    Returns ``(centres, memberships)``: ``centres`` has ``keys, c, centres ARRAY<ARRAY>,
    rounds, fpc``; ``memberships`` has ``keys, c, pid, u ARRAY, Cluster`` (argmax).
    """
    spark: SparkSession = df.sparkSession
    keys = list(keys)
    cs_col = F.explode(F.array(*[F.lit(int(c)) for c in cs])).alias("n_clusters")
    pts = cut_lineage(df.select(*keys, "pid", *cols).na.drop(subset=cols).select("*", cs_col))
    key_schema = ", ".join(k + " string" for k in keys)
    out_schema = f"{key_schema}, n_clusters int, centres array<array<double>>, rounds int"
    # groups up to LOCAL_MAX_POINTS iterate inside one task (bounded memory); larger groups
    # iterate as distributed rounds below, so no unbounded group is ever gathered
    sizes = pts.groupBy(*keys, "n_clusters").agg(F.count(F.lit(1)).alias("npts"))
    small = sizes.filter(F.col("npts") <= LOCAL_MAX_POINTS).select(*keys, "n_clusters")
    local = (join_small(pts, small, [*keys, "n_clusters"], "left_semi")
             .withColumn("k0", _init_class(seed, init))
             .groupBy(*keys, "n_clusters")
             .applyInPandas(_local_fcm(cols, keys, m, error, maxiter), out_schema))
    big = sizes.filter(F.col("npts") > LOCAL_MAX_POINTS).select(*keys, "n_clusters")
    pts_big = join_small(pts, big, [*keys, "n_clusters"], "left_semi")
    state = _initial_centres(pts_big, cols, keys, seed, init).withColumn(
        "prev", F.lit(None).cast("array<array<double>>"))
    done_rows = []
    active = [tuple(r) for r in state.select(*keys, "n_clusters", "prev", "cur").collect()]
    rounds = 0
    while active and rounds < maxiter - 1:
        rounds += 1
        st = spark.createDataFrame(active, schema=f"{', '.join(k + ' string' for k in keys)}, "
                                                  "n_clusters int, prev array<array<double>>, cur array<array<double>>")
        res = fcm_round(pts_big, st, cols, keys, m).collect()
        by_key: dict = {}
        for r in res:
            by_key.setdefault(tuple(r[k] for k in keys) + (r["n_clusters"],), []).append(r)
        nxt = []
        for row in active:
            key = tuple(row[:len(keys) + 1])
            rs = sorted(by_key.get(key, []), key=lambda r: r["k"])
            if not rs:
                continue
            err = None if rs[0]["e2"] is None else sum(r["e2"] for r in rs) ** 0.5
            if err is not None and err < error:
                done_rows.append((*key, row[-1], rounds))
            else:
                new = [[r[f"s_{x}"] / r["w"] if r["w"] else c0 for x, c0 in zip(cols, old)]
                       for r, old in zip(rs, row[-1])]
                nxt.append((*key, row[-1], new))
        active = nxt
    for row in active:  # not converged within maxiter: keep the last centres
        done_rows.append((*row[:len(keys) + 1], row[-1], rounds))
    centres = cut_lineage(local.unionByName(spark.createDataFrame(done_rows, schema=out_schema)))
    memb = with_memberships(pts, centres, cols, m, keys)
    fpc = memb.groupBy(*keys, "n_clusters").agg(
        (F.sum(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)) / F.count(F.lit(1))).alias("fpc"))
    return centres.join(fpc, [*keys, "n_clusters"], "left"), memb


def with_memberships(pts: DataFrame, centres: DataFrame, cols: list[str], m: float = 2.0,
                     keys=("codigo",)) -> DataFrame:
    """Memberships from final centres and the class of greatest membership."""
    keys = list(keys)
    j = join_small(pts, centres.select(*keys, "n_clusters", "centres"), [*keys, "n_clusters"])
    j = j.withColumn("u", _memberships(cols, "centres", m))
    return j.select(*keys, "n_clusters", "pid", *cols, "u", argmax(F.col("u")).alias("Cluster"))


def membership_columns(memb: DataFrame, c: int) -> DataFrame:
    """One ``Pertenencia_Cluster{i}`` column per cluster."""
    return memb.withColumns({f"Pertenencia_Cluster{i}": F.col("u")[i] for i in range(c)})


def choose_c(fits: DataFrame, keys=("codigo",)) -> DataFrame:
    """C with the greatest fuzzy partition coefficient per field (smallest c on ties)."""
    return fits.groupBy(*keys).agg(F.min_by("n_clusters", F.struct(-F.col("fpc"), F.col("n_clusters"))).alias("n_clusters"))
