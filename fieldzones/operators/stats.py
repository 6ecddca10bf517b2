"""Imputation, standardisation and PCA per field.

Per-field moments are one partial aggregate (a hot field is pre-aggregated on every
partition before the shuffle), joined back with a size-checked broadcast.  PCA needs only
the p x p covariance of each field: the aggregate produces it, and the eigen step takes whole
batches of these rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldzones.session import cut_lineage, join_small


def impute_mean(df: DataFrame, cols: list[str], keys=("codigo",)) -> DataFrame:
    """Null -> mean of the column within the field (``SimpleImputer('mean')``)."""
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    j = join_small(df, means, list(keys))
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in cols}) \
        .drop(*[f"_m_{c}" for c in cols])


def standardise(df: DataFrame, cols: list[str], keys=("codigo",)) -> DataFrame:
    """M1: (x - mean) / population std within the field; a zero std divides by 1."""
    mom = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                                *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    j = join_small(df, mom, list(keys))
    out = j.withColumns({
        c: (F.col(c) - F.col(f"_m_{c}"))
        / F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        for c in cols})
    return out.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


def covariance(df: DataFrame, cols: list[str], keys=("codigo",)) -> DataFrame:
    """Sample covariance (n-1) of every column pair per field, one row per field."""
    p = len(cols)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i in range(p):
        for j in range(i, p):
            aggs.append(F.covar_samp(cols[i], cols[j]).alias(f"c_{i}_{j}"))
    return df.groupBy(*keys).agg(*aggs)


def pca_fit(df: DataFrame, cols: list[str], keys=("codigo",)) -> DataFrame:
    """Principal components of standardised columns, per field.

    Output one row per (field, component k = 1..p): ``eigenvalue`` (explained variance,
    n-1), ``ratio``, ``cumulative`` (%), ``component`` (unit vector over ``cols``) and
    ``loading`` = component * sqrt(eigenvalue).  Sign: largest absolute entry positive.
    """
    p = len(cols)
    cov = covariance(df, cols, keys)
    keys = list(keys)

    def eig(batches):
        for pdf in batches:  # one row for each field
            if not len(pdf):
                continue
            m = np.zeros((len(pdf), p, p))
            for i in range(p):
                for j in range(i, p):
                    m[:, i, j] = m[:, j, i] = np.nan_to_num(pdf[f"c_{i}_{j}"].to_numpy(float))
            w, v = np.linalg.eigh(m)
            w, v = np.clip(w[:, ::-1], 0.0, None), v[:, :, ::-1]
            top = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None, :], axis=1)
            v = v * np.where(top < 0, -1.0, 1.0)
            total = w.sum(axis=1, keepdims=True)
            ratio = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
            vec = v.transpose(0, 2, 1).reshape(-1, p)
            out = {c: np.repeat(pdf[c].to_numpy(), p) for c in keys}
            yield pd.DataFrame(out | {"k": np.tile(np.arange(1, p + 1), len(pdf)), "eigenvalue": w.ravel(), "ratio": ratio.ravel(),
                                      "component": list(vec), "loading": list(vec * np.sqrt(w.ravel())[:, None])})

    key_schema = ", ".join(f"{k} string" for k in keys)
    schema = (f"{key_schema}, k int, eigenvalue double, ratio double, "
              "component array<double>, loading array<double>")
    fit = cov.mapInPandas(eig, schema)
    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    # One window per field over p rows (p = number of variables), never over points
    return fit.withColumn("cumulative", F.sum("ratio").over(w) * 100.0)


def pca_transform(z: DataFrame, fit: DataFrame, cols: list[str], n_components: int = 3,
                  keys=("codigo",)) -> DataFrame:
    """M3: scores ``PC1..PCn`` of standardised rows (dot products with broadcast components), as
    many as there are columns at most."""
    n_components = min(n_components, len(cols))
    comps = (fit.filter(F.col("k") <= n_components).groupBy(*keys)
             .agg(F.sort_array(F.collect_list(F.struct("k", "component"))).alias("_cs")))
    j = join_small(z, comps, list(keys))
    scores = {}
    for k in range(n_components):
        vec = F.col("_cs")[k]["component"]
        s = None
        for i, c in enumerate(cols):
            term = F.col(c) * vec[i]
            s = term if s is None else s + term
        scores[f"PC{k + 1}"] = s
    return j.withColumns(scores).drop("_cs")


def component_matrix(fit: DataFrame, cols: list[str], n_components: int = 3,
                     keys=("codigo",)) -> DataFrame:
    """M3: the component matrix with one row per variable and columns ``PC1..PCn``."""
    f = fit.filter(F.col("k") <= n_components)
    long = f.select(*keys, "k", F.posexplode("component").alias("i", "v"))
    names = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i") + 1)
    long = long.withColumn("variable", names).withColumn("pc", F.concat(F.lit("PC"), F.col("k")))
    return (long.groupBy(*keys, "variable")
            .pivot("pc", [f"PC{k + 1}" for k in range(n_components)]).agg(F.first("v")))


def exact_quantiles(df: DataFrame, keys, probs, value: str = "value", partitions: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group: ``keys, p, quantile``.

    Rows are sorted once in ranges of (keys, value), which splits a hot group by value, and the
    rows of each group are counted for each range.  A running sum of these counts tells the
    range and the place in it of every wanted order statistic, which one equi-join picks.
    """
    keys = list(keys)
    v = df.select(*keys, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    order = [*keys, "v"]
    rows = v.repartitionByRange(partitions, *order) if partitions else v.repartitionByRange(*order)
    rows = cut_lineage(rows.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
                       .withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = rows.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # windows over one row for each group and range, never over values
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn(
        "n", F.sum("c").over(Window.partitionBy(*keys)))
    wanted = counts.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
    rank = F.col("p") * (F.col("n") - 1)
    low = F.floor(rank)
    wanted = wanted.select("*", (rank - low).alias("share"), F.explode(F.array(
        F.struct(low.alias("k"), F.lit(0).alias("side")),
        F.struct(F.least(low + 1, F.col("n") - 1).alias("k"), F.lit(1).alias("side")))).alias("w"))
    here = (F.col("w.k") >= F.col("before")) & (F.col("w.k") < F.col("before") + F.col("c"))
    picks = wanted.filter(here).select(*keys, "p", "share", F.col("w.side").alias("side"), "part",
                                       (F.col("first") + F.col("w.k") - F.col("before")).alias("at"))
    got = join_small(rows.select("part", "at", "v"), picks, ["part", "at"])
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("v")))
    out = got.groupBy(*keys, "p", "share").agg(side(0).alias("a"), side(1).alias("b"))
    return out.select(*keys, "p", (F.col("a") + F.col("share") * (F.col("b") - F.col("a"))).alias("quantile"))
