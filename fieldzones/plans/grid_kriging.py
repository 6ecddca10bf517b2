"""Checked queries: variogram, spherical model and kriging of whole grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldzones import fixtures as fx
from fieldzones.operators import lattice, raster, sampling, spatial, zonal
from fieldzones.plans.design import _FEATURES_SQL, CELL, grid_features
from fieldzones.plans.registry import register, rounded
from fieldzones.plans.zones import fields
from fieldzones.session import cut_lineage

SOIL = ["Arcilla", "Arena", "Limo", "pH"]
N_LAGS = 6
_INPUTS = ("fx_field_vertices", "fx_raster_meta", "fx_pixels")


def grid_values(spark, sf):
    """The soil layers at every grid point, one row per variable."""
    long = sampling.unpivot(grid_features(spark, sf), SOIL, keys=("codigo", "pid", "x", "y"), name="variable")
    return long.filter(F.col("value").isNotNull())


def grid_extent(spark, sf):
    return raster.grid_meta(spatial.make_grid(fields(spark, sf), CELL), CELL).withColumn("layer", F.lit("kriged"))


def blocks(spark, sf):
    return lattice.lattice_blocks(grid_values(spark, sf), CELL, extent=grid_extent(spark, sf))


def model(found):
    return cut_lineage(lattice.fit_weighted(lattice.lattice_variogram(found, N_LAGS, CELL)))


def solved(spark, sf):
    found = blocks(spark, sf)
    return lattice.solve_lattice(found, model(found), CELL)


_LONG_SQL = _FEATURES_SQL + """,
lg as (select codigo, pid, x, y, v.variable, v.value
       from feat cross join lateral (values """ + ", ".join(f"('{v}', {v})" for v in SOIL) + """) v(variable, value) where v.value is not null)
"""

_BINS_SQL = _LONG_SQL + f""",
rings as (select a.codigo, a.variable, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d, count(*) as n,
                 sum((a.value - b.value) * (a.value - b.value)) as sq
          from lg a join lg b on a.codigo = b.codigo and a.variable = b.variable and a.pid < b.pid group by 1, 2, 3),
ends as (select codigo, variable, min(d) as least, max(d) as most from rings group by codigo, variable),
placed as (select r.*, least(cast(floor((d - least) / ((most - least) / {N_LAGS}e0)) as int), {N_LAGS - 1}) as lag_bin
           from rings r join ends e on e.codigo = r.codigo and e.variable = r.variable),
bins as (select codigo, variable, lag_bin, sum(d * n) / sum(n) as lag, sum(sq) / (2 * sum(n)) as gamma, cast(sum(n) as bigint) as n_pairs
         from placed group by codigo, variable, lag_bin)
"""


@register("variogram_full", fx.oracle(_BINS_SQL + "select codigo, variable, lag_bin, round(lag, 6) as lag, round(gamma, 6) as gamma, n_pairs from bins", *_INPUTS))
def q_variogram_full(spark, sf):
    """M9: semivariogram of every soil layer over all pairs of grid points, by lattice offset."""
    return rounded(lattice.lattice_variogram(blocks(spark, sf), N_LAGS, CELL))


_FIT_SQL = _BINS_SQL + f""",
f_ends as (select codigo, variable, min(lag) as f, max(lag) as l from bins group by codigo, variable),
f_tried as (select codigo, variable, k, f * 5e-1 + k * ((l * 3e0 - f * 5e-1) / {lattice.N_RANGES - 1}e0) as rng from f_ends, range(0, {lattice.N_RANGES}) r(k)),
f_rows as (select b.codigo, b.variable, c.k, c.rng, cast(n_pairs as double) as w, gamma as g,
             case when lag < rng then 15e-1 * (lag / rng) - 5e-1 * (lag / rng) * (lag / rng) * (lag / rng) else 1e0 end as s
      from bins b join f_tried c on c.codigo = b.codigo and c.variable = b.variable),
f_sums as (select codigo, variable, k, rng, sum(w) as w, sum(w * s) as ws, sum(w * g) as wg, sum(w * s * s) as wss, sum(w * s * g) as wsg, sum(w * g * g) as wgg
      from f_rows group by codigo, variable, k, rng),
f_slope as (select *, case when w * wss - ws * ws > 1e-9 * w * wss then (w * wsg - ws * wg) / (w * wss - ws * ws) else 0e0 end as b from f_sums),
f_line as (select *, (wg - b * ws) / w as a from f_slope),
f_model as (select *, case when b < 0 then greatest(wg / w, 0e0) when a < 0 then 0e0 else a end as nugget,
             case when b < 0 then 0e0 when a < 0 then greatest(wsg / wss, 0e0) else b end as psill from f_line),
f_sse as (select *, wgg - 2 * nugget * wg - 2 * psill * wsg + nugget * nugget * w + 2 * nugget * psill * ws + psill * psill * wss as sse from f_model)
select codigo, variable, round(nugget, 4) as nugget, round(psill, 4) as psill, round(rng, 4) as "range"
from (select *, row_number() over (partition by codigo, variable order by round(sse / wgg, 9), k) as place from f_sse) x where place = 1
"""


@register("variogram_fit", fx.oracle(_FIT_SQL, *_INPUTS))
def q_variogram_fit(spark, sf):
    """M9: spherical model weighted with the pairs, the best of 200 ranges."""
    return rounded(model(blocks(spark, sf)).select("codigo", "variable", "nugget", "psill", "range"), 4)


@register("kriging_grid_system", fx.oracle(_LONG_SQL + "select codigo, variable, round(x, 3) as x, round(y, 3) as y, round(value, 6) as datum, 0e0 as residual from lg", *_INPUTS))
def q_kriging_grid_system(spark, sf):
    """At every node, what the solution leaves of the datum: |C u + mean - datum|, C u summed offset by offset."""
    out = lattice.lattice_product(solved(spark, sf), CELL)
    return rounded(out.select("codigo", "variable", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "datum", F.abs(F.col("value") - F.col("datum")).alias("residual")))


def kriged(spark, sf):
    cells = lattice.krige_lattice(solved(spark, sf), CELL).withColumn("layer", F.lit("kriged"))
    return spatial.pixels_in_polygons(cells, fields(spark, sf), grid_extent(spark, sf))


@register("kriging_grid")
def q_kriging_grid(spark, sf):
    """Every soil layer kriged from its whole grid to the 10 m raster, clipped to the field
    (rows check; tests hold the values against a dense solve)."""
    out = kriged(spark, sf).select("codigo", F.col("variable").alias("layer"), "row", "col", "value")
    return rounded(zonal.fill_nodata(out))
