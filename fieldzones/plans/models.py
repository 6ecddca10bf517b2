"""Checked queries: random-forest soil models, variogram and kriging."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldzones import fixtures as fx
from fieldzones.operators import forest, kriging, raster, samples, sampling, spatial, zonal
from fieldzones.plans.design import grid_features
from fieldzones.plans.registry import register, rounded
from fieldzones.plans.zones import FX_LAYERS, fields
from fieldzones.session import cut_lineage, join_small

LAB_VARS = ["Arcilla", "Arena", "Limo", "pH", "MO"]
NUM_TREES = 1500  # as in the reference (1500 trees, 3 features per split, seed 42)
MAX_LAG = 200.0
N_LAGS = 6


def training_table(spark, sf):
    """Sample points with the predictor layers sampled at them and their lab results."""
    pts = fx.table(spark, sf, "fx_samples").select("codigo", F.col("n").alias("pid"), "x", "y")
    feat = raster.sample_layers(pts, fx.table(spark, sf, "fx_pixels"),
                                fx.table(spark, sf, "fx_raster_meta"), samples.predictor_columns(FX_LAYERS))
    feat = samples.standardise_layers(feat.withColumnRenamed("pid", "n"))
    return samples.join_lab(feat, fx.table(spark, sf, "fx_soil_lab"))


def _predictors(df):
    return samples.predictor_columns(df.columns)


_FITS: dict = {}


def importances(spark, sf):
    """Forest importances, fitted once per session and scale (the three queries share them)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITS:
        train = cut_lineage(training_table(spark, sf))
        imp, _ = forest.rf_importance(train, samples.SOIL_VARIABLES, _predictors(train), NUM_TREES)
        _FITS[key] = (train, cut_lineage(imp))
    return _FITS[key]


@register("rf_importance")
def q_rf_importance(spark, sf):
    """Forest importances per soil variable, ranked (rows check)."""
    return rounded(importances(spark, sf)[1])


@register("rf_selection")
def q_rf_selection(spark, sf):
    """Predictors above 0.05 importance and their number per variable (rows check)."""
    sel = forest.select_predictors(importances(spark, sf)[1])
    return forest.count_selected(sel).join(
        sel.groupBy("variable").agg(F.sort_array(F.collect_list("predictor")).alias("predictors")), "variable")


@register("rf_predict_grid")
def q_rf_predict_grid(spark, sf):
    """M7/M8: refit on the selected predictors and predict every grid point (rows check)."""
    train, imp = importances(spark, sf)
    models = forest.rf_fit_selected(train, forest.select_predictors(imp), NUM_TREES)
    grid = samples.standardise_layers(grid_features(spark, sf))
    out = forest.rf_predict(grid, models)
    return rounded(out.select("codigo", "pid", *[v for v in LAB_VARS if v in out.columns]))


def lab_points(spark, sf):
    """Laboratory results at their sample points, long format (one row per variable)."""
    pts = fx.table(spark, sf, "fx_samples").select("codigo", "n", "x", "y")
    lab = samples.join_lab(pts, fx.table(spark, sf, "fx_soil_lab"))
    long = sampling.unpivot(lab, LAB_VARS, keys=("codigo", "n", "x", "y"), name="variable")
    return long.filter(F.col("value").isNotNull()).withColumnRenamed("n", "pid")


_VARIO_SQL = f"""
with p as (select m.codigo, m.n, m.x, m.y, l.Arcilla, l.Arena, l.Limo, l.pH, l.MO
           from fx_samples m join fx_soil_lab l on l.codigo = m.codigo and l.n = m.n),
lg as (select codigo, n, x, y, v.variable, v.value from p
       cross join lateral (values ('Arcilla', Arcilla), ('Arena', Arena), ('Limo', Limo), ('pH', pH), ('MO', MO)) v(variable, value)
       where v.value is not null),
pr as (select a.codigo, a.variable, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d,
              a.value - b.value as dz
       from lg a join lg b on a.codigo = b.codigo and a.variable = b.variable and a.n < b.n
       where sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {MAX_LAG}e0)
select codigo, variable, least(cast(floor(d / {MAX_LAG / N_LAGS!r}e0) as int), {N_LAGS - 1}) as lag_bin,
       round(avg(d), 6) as lag, round(avg(5e-1 * dz * dz), 6) as gamma, count(*) as n_pairs
from pr group by codigo, variable, least(cast(floor(d / {MAX_LAG / N_LAGS!r}e0) as int), {N_LAGS - 1})
"""


@register("variogram", fx.oracle(_VARIO_SQL.replace("e0e0", "e0"), "fx_samples", "fx_soil_lab"))
def q_variogram(spark, sf):
    """M9: empirical semivariogram of every lab variable per field (6 lags up to 200 m)."""
    return rounded(kriging.variogram(lab_points(spark, sf), MAX_LAG, N_LAGS))


def kriged(spark, sf):
    pts = lab_points(spark, sf)
    model = kriging.fit_spherical(kriging.variogram(pts, MAX_LAG, N_LAGS))
    grid = spatial.make_grid(fields(spark, sf), 10.0)
    meta = cut_lineage(raster.grid_meta(grid, 10.0).withColumn("layer", F.lit("kriged")))
    targets = raster.target_grid(meta).select("codigo", "tid", "x", "y")
    k = kriging.krige(pts.select("codigo", "variable", "pid", "x", "y", "value"),
                      targets, model)
    # the cell follows from its number: targets are generated, and never joined back
    row = F.expr("tid div n_cols").cast("int")
    cells = join_small(k, meta.select("codigo", "n_cols"), "codigo").withColumns({"layer": F.lit("kriged"), "row": row, "col": (F.col("tid") % F.col("n_cols")).cast("int")})
    # Clip to the field with the scanline intervals of the kriged grid
    return spatial.pixels_in_polygons(cells.select("codigo", "layer", "row", "col", "variable", "value"),
                                      fields(spark, sf), meta)


_LONG_LAB_SQL = """
with p as (select m.codigo, m.x, m.y, l.Arcilla, l.Arena, l.Limo, l.pH, l.MO
           from fx_samples m join fx_soil_lab l on l.codigo = m.codigo and l.n = m.n),
lg as (select codigo, x, y, v.variable, v.value from p
       cross join lateral (values ('Arcilla', Arcilla), ('Arena', Arena), ('Limo', Limo), ('pH', pH), ('MO', MO)) v(variable, value)
       where v.value is not null)
"""


@register("kriging_at_samples", fx.oracle(_LONG_LAB_SQL + """
select codigo, variable, count(*) as n_places, 0e0 as largest_difference
from (select distinct codigo, variable, x, y from lg) t group by codigo, variable""", "fx_samples", "fx_soil_lab"))
def q_kriging_at_samples(spark, sf):
    """Without a nugget the kriged value at every sampled place is the (mean) datum there."""
    pts = cut_lineage(lab_points(spark, sf))
    model = kriging.fit_spherical(kriging.variogram(pts, MAX_LAG, N_LAGS)).withColumn("nugget", F.lit(0.0))
    places = pts.groupBy("codigo", "variable", "x", "y").agg(F.avg("value").alias("datum"))
    places = cut_lineage(places.withColumn("tid", F.monotonically_increasing_id()))
    out = kriging.krige(pts, places.select("codigo", "tid", "x", "y"), model)
    both = out.join(places.select("codigo", "variable", "tid", "datum"), ["codigo", "variable", "tid"])
    return both.groupBy("codigo", "variable").agg(
        F.count(F.lit(1)).alias("n_places"), F.round(F.max(F.abs(F.col("value") - F.col("datum"))), 4).alias("largest_difference"))


@register("kriging_cells", fx.oracle(_LONG_LAB_SQL + """,
b as (select codigo, min(x) as xmin, min(y) as ymin, cast(ceil((max(x) - min(x)) / 1e1) as int) as nx,
             cast(ceil((max(y) - min(y)) / 1e1) as int) as ny from fx_field_vertices group by codigo),
c as (select codigo, r, k, xmin + (k + 5e-1) * 1e1 as x, ymin + (ny - 1) * 1e1 - (r + 5e-1) * 1e1 as y
      from b, range(0, 100000) a(r), range(0, 1000) d(k) where r < ny - 1 and k < nx - 1),
e as (select a.codigo, a.x as ax, a.y as ay, b.x as bx, b.y as by
      from fx_field_vertices a join fx_field_vertices b on a.codigo = b.codigo and b.seq = a.seq + 1),
i as (select c.codigo, c.r, c.k, sum(case when ((e.ay > c.y) <> (e.by > c.y)) and c.x < (e.bx - e.ax) * (c.y - e.ay) / (e.by - e.ay) + e.ax then 1 else 0 end) as n
      from c join e on e.codigo = c.codigo group by c.codigo, c.r, c.k),
f as (select codigo, count(*) as n_cells from i where n % 2 = 1 group by codigo)
select f.codigo, v.variable as layer, n_cells, 0 as n_missing
from f join (select distinct codigo, variable from lg) v on v.codigo = f.codigo""", "fx_samples", "fx_soil_lab", "fx_field_vertices"))
def q_kriging_cells(spark, sf):
    """One value for every cell of the field and every variable with data."""
    out = kriged(spark, sf)
    missing = F.count_if(F.col("value").isNull() | F.isnan("value"))
    return out.groupBy("codigo", F.col("variable").alias("layer")).agg(F.count(F.lit(1)).alias("n_cells"), missing.cast("int").alias("n_missing"))


@register("kriging")
def q_kriging(spark, sf):
    """Spherical model per field and variable, ordinary kriging onto the
    10 m raster (cell centres, row 0 on top) clipped to the field, -9999 for no data."""
    out = kriged(spark, sf).select("codigo", F.col("variable").alias("layer"), "row", "col", "value")
    return rounded(zonal.fill_nodata(out))
