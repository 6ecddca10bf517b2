"""Random-forest soil models (M6, M7, M8, P19, O1, Z13) pooled over all fields.

One pooled model per soil variable over all fields (``fields=`` restricts the training
rows to some codes for single-field behaviour).  The trees grow and predict as those of
``field_forest`` do, all fields as one group, with split points between neighbouring values of
the whole table; only the names of the selected predictors reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldzones.operators import field_forest
from fieldzones.operators.samples import coerce_numeric, present
from fieldzones.operators.stats import impute_mean
from fieldzones.session import cut_lineage

IMPORTANCE_THRESHOLD = 0.05


@dataclass
class SoilModel:
    variable: str
    predictors: list[str]
    nodes: DataFrame


def _grown(train: DataFrame, variables: list[str], predictors: list[str], num_trees: int, seed: int,
           max_features: int, max_bins: int) -> DataFrame:
    """Nodes of the forests of ``variables``; rows with a null or NaN in one's columns are left out of it."""
    data = coerce_numeric(train, [*predictors, *variables])
    data = data.select(F.lit("").alias("codigo"), *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in [*predictors, *variables]])
    rows, bins = field_forest.training_rows(data, variables, predictors, max_bins)
    # unbounded trees as in the usual defaults: leaves of 1 and a depth limit of 30
    return field_forest.grow(rows, bins, None, len(predictors), num_trees, seed, max_features, every_bin=True)


def rf_importance(train: DataFrame, variables: list[str], predictors: list[str],
                  num_trees: int = 1500, seed: int = 42, max_features: int = 3,
                  fields: list[str] | None = None, max_bins: int | None = None) -> tuple[DataFrame, dict]:
    """M6/O1: importance of every predictor for every soil variable present (P20 skips the
    rest), ranked in descending order.  Returns ``(importance table, fitted models)``.

    ``max_bins`` bounds the split points of a predictor; the default, the number of training
    rows, lets every value be one."""
    if fields is not None:
        train = train.filter(F.col("codigo").isin(fields))
    have, _skipped = present(train.columns, variables)
    bins = max_bins or max(32, train.count())
    nodes = _grown(train, have, predictors, num_trees, seed, max_features, bins)
    imp = field_forest.importances(nodes, predictors).select("variable", "predictor", "importance")
    w = Window.partitionBy("variable").orderBy(F.desc("importance"), "predictor")
    models = {v: SoilModel(v, predictors, nodes.filter(F.col("variable") == v)) for v in have}
    return imp.withColumn("rank", F.row_number().over(w)), models


def select_predictors(imp: DataFrame, threshold: float = IMPORTANCE_THRESHOLD) -> DataFrame:
    """Predictors with importance strictly above the threshold."""
    return imp.filter(F.col("importance") > threshold)


def count_selected(selected: DataFrame) -> DataFrame:
    """Number of selected predictors per variable."""
    return selected.groupBy("variable").agg(F.count(F.lit(1)).alias("n_predictors"))


def rf_fit_selected(train: DataFrame, selected: DataFrame, num_trees: int = 1500, seed: int = 42,
                    max_features: int = 3, fields: list[str] | None = None,
                    max_bins: int | None = None) -> dict[str, SoilModel]:
    """M7: refit each variable on its selected predictors; none selected -> variable skipped."""
    if fields is not None:
        train = train.filter(F.col("codigo").isin(fields))
    chosen: dict[str, list[str]] = {}
    for r in selected.orderBy("variable", "rank").collect():  # a few rows per variable
        chosen.setdefault(r["variable"], []).append(r["predictor"])
    bins = max_bins or max(32, train.count())
    sets: dict[tuple, list[str]] = {}
    for v, names in chosen.items():
        sets.setdefault(tuple(names), []).append(v)
    models = {}
    for names, variables in sets.items():  # the variables of equal predictors grow together
        nodes = _grown(train, variables, list(names), num_trees, seed, max_features, bins)
        models |= {v: SoilModel(v, list(names), nodes.filter(F.col("variable") == v)) for v in variables}
    return {v: models[v] for v in chosen}


def rf_predict(grid: DataFrame, models: dict[str, SoilModel], keys=("codigo",)) -> DataFrame:
    """M8: predict every variable on the grid - predictors in training order, coerced to
    numbers, missing values filled with the field mean; a model whose predictors are
    missing from the grid is skipped.  All predictors are filled once; the values come back by
    row."""
    usable = {v: sm for v, sm in models.items() if all(p in grid.columns for p in sm.predictors)}
    names = sorted({p for sm in usable.values() for p in sm.predictors})
    filled = {p: f"_x{i}" for i, p in enumerate(names)}
    x = grid.withColumns({t: F.col(p) for p, t in filled.items()}).drop(*usable)
    x = impute_mean(coerce_numeric(x, filled.values()), list(filled.values()), keys)
    if not usable:
        return x
    x = cut_lineage(x.withColumn("_row", F.monotonically_increasing_id()))
    points = x.select(F.lit("").alias("codigo"), F.col("_row").alias("pid"), *[F.col(t).alias(p) for p, t in filled.items()])
    own = lambda sm: sm.nodes.withColumn("f", F.get(F.array(*[F.lit(names.index(p)) for p in sm.predictors]), F.col("f")))
    nodes = reduce(DataFrame.unionByName, [own(sm) for sm in usable.values()])
    values = field_forest.point_values(points, nodes, list(usable), names, null_right=True, near=True)
    values = values.select(F.col("pid").alias("_row"), *[F.get("v", F.lit(i)).alias(v) for i, v in enumerate(usable)])
    return x.join(values, "_row", "left").drop("_row", *filled.values())
