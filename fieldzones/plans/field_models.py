"""Checked queries: a random forest for each field and soil variable (M6, M7, M8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldzones import fixtures as fx
from fieldzones.operators import field_forest, samples
from fieldzones.plans.design import _GRID_SQL, grid_features
from fieldzones.plans.models import LAB_VARS, NUM_TREES, training_table
from fieldzones.plans.registry import register, rounded
from fieldzones.session import cut_lineage

PREDICTORS = ["NDVI_Pl_1", "EVI_Hist1", "PROD_1"]
_LAYERS = ["NDVI_Pl_1", "EVI_Hist_1", "PROD_1"]

_TRAIN_SQL = """
tr as (select s.codigo, s.n, l.Arcilla, l.Arena, l.Limo, l.pH, l.MO, """ + ", ".join(f"max(case when p.layer = '{x}' then p.value end) as {x}" for x in _LAYERS) + """
       from fx_samples s join fx_soil_lab l on l.codigo = s.codigo and l.n = s.n join fx_raster_meta m on m.codigo = s.codigo
       left join fx_pixels p on p.codigo = s.codigo and p.layer = m.layer
            and p."row" = cast(floor((m.y0 - s.y) / m.res_y) as int) and p."col" = cast(floor((s.x - m.x0) / m.res_x) as int)
       group by s.codigo, s.n, l.Arcilla, l.Arena, l.Limo, l.pH, l.MO),
cases as (select tr.*, v.variable, v.y from tr cross join lateral (values """ + ", ".join(f"('{v}', {v})" for v in LAB_VARS) + """) v(variable, y)
          where v.y is not null and """ + " and ".join(f"{x} is not null" for x in _LAYERS) + """)
"""
_INPUTS = ("fx_samples", "fx_soil_lab", "fx_raster_meta", "fx_pixels")

_STUMP_SQL = "with " + _TRAIN_SQL + """,
u as (select codigo, variable, y, v.f, v.x from cases cross join lateral (values """ + ", ".join(f"({i}, {x})" for i, x in enumerate(_LAYERS)) + """) v(f, x)),
h as (select codigo, variable, f, x, count(*) as w, sum(y) as s from u group by codigo, variable, f, x),
r as (select *, sum(w) over up as wl, sum(s) over up as sl, sum(w) over whole as wt, sum(s) over whole as st, lead(x) over up as nx
      from h window up as (partition by codigo, variable, f order by x), whole as (partition by codigo, variable, f)),
g as (select *, round(sl * sl / wl + (st - sl) * (st - sl) / (wt - wl) - st * st / wt, 6) as gain from r where nx is not null),
best as (select *, row_number() over (partition by codigo, variable order by gain desc, f, x) as place from g)
select codigo, variable, f, round((x + nx) / 2, 9) as threshold, gain, round(sl / wl, 9) as left_value, round((st - sl) / (wt - wl), 9) as right_value
from best where place = 1 and gain > 0
"""


@register("rf_stump", fx.oracle(_STUMP_SQL, *_INPUTS))
def q_rf_stump(spark, sf):
    """M6: the first split of every field's tree without bootstrap, over all predictors."""
    rows, bins = field_forest.training_rows(training_table(spark, sf), LAB_VARS, PREDICTORS)
    nodes = field_forest.grow(rows, bins, None, len(PREDICTORS), num_trees=1, max_depth=1, bootstrap=False)
    root = nodes.filter("node = 1 AND f IS NOT NULL").select("codigo", "variable", "f", "threshold", "gain")
    sides = nodes.groupBy("codigo", "variable").agg(F.max(F.expr("CASE WHEN node = 2 THEN value END")).alias("left_value"),
                                                    F.max(F.expr("CASE WHEN node = 3 THEN value END")).alias("right_value"))
    return rounded(root.join(sides, ["codigo", "variable"]), 9)


@register("rf_field_importance")
def q_rf_field_importance(spark, sf):
    """M6/O1: importances of every field's own forests, 1,500 trees each (rows check)."""
    rows, bins = field_forest.training_rows(training_table(spark, sf), LAB_VARS, PREDICTORS)
    nodes = field_forest.grow(rows, bins, None, len(PREDICTORS), NUM_TREES)
    return rounded(field_forest.importances(nodes, PREDICTORS).drop("f"))


def fitted(spark, sf):
    train = cut_lineage(training_table(spark, sf))
    forests = field_forest.fit(train, LAB_VARS, PREDICTORS, NUM_TREES)
    return train, forests, field_forest.predict(samples.standardise_layers(grid_features(spark, sf)), forests)


@register("rf_field_predict")
def q_rf_field_predict(spark, sf):
    """M7/M8: every grid point by its own field's forests on their selected predictors (rows check)."""
    return rounded(fitted(spark, sf)[2])


_CHECK_SQL = _GRID_SQL.rstrip() + ",\n" + _TRAIN_SQL + """
select c.codigo, c.variable, c.importance, g.n as n_points, true as in_range
from (select codigo, variable, case when count(distinct y) > 1 then 1e0 else 0e0 end as importance from cases group by codigo, variable) c
join (select codigo, count(*) as n from grid group by codigo) g on g.codigo = c.codigo
"""


@register("rf_field_checks", fx.oracle(_CHECK_SQL, "fx_field_vertices", *_INPUTS))
def q_rf_field_checks(spark, sf):
    """M6-M8: the importances of a forest add up to 1, and it predicts every point inside the range it has seen."""
    train, forests, out = fitted(spark, sf)
    total = forests.importances.groupBy("codigo", "variable").agg(F.sum("importance").alias("importance"))
    rows, _ = field_forest.training_rows(train, LAB_VARS, PREDICTORS)
    seen = rows.groupBy("codigo", "variable").agg(F.min("y").alias("least"), F.max("y").alias("most"))
    span = out.groupBy("codigo", "variable").agg(F.count(F.lit(1)).alias("n_points"), F.min("value").alias("low"), F.max("value").alias("high"))
    both = total.join(seen, ["codigo", "variable"]).join(span, ["codigo", "variable"])
    inside = (F.col("low") >= F.col("least") - 1e-9) & (F.col("high") <= F.col("most") + 1e-9)
    return rounded(both.select("codigo", "variable", "importance", "n_points", inside.alias("in_range")))
