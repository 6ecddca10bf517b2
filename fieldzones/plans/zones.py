"""Checked queries: zone statistics and report (the flagship), zone values, areas, bounds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldzones import fixtures as fx
from fieldzones.operators import sampling, spatial, zonal
from fieldzones.plans.registry import register, rounded
from fieldzones.session import run_dir
from fieldzones.sources import io

# Layers of the fixture rasters.
FX_LAYERS = ["NDVI_Pl_1", "EVI_Hist_1", "PROD_1", "Arcilla", "Arena", "Limo", "pH"]


def _zones(spark, sf):
    return spatial.rectangles(fx.table(spark, sf, "fx_zones"), keys=("codigo", "Zonas"))


def _pixels(spark, sf):
    return fx.table(spark, sf, "fx_pixels")


def zone_layer(spark, sf):
    return zonal.zone_statistics(_zones(spark, sf), _pixels(spark, sf), FX_LAYERS,
                                 fx.table(spark, sf, "fx_raster_meta"))


def _avg_cols(prefix=""):
    return ",\n  ".join(f"avg(case when layer = '{l}' then value end) as {l}" for l in FX_LAYERS)


_ZONE_STATS_SQL = f"""
with zp as (
  select z.codigo, z.Zonas, p.layer, p.value
  from fx_pixels p join fx_zones z
    on p.codigo = z.codigo and p.x > z.x1 and p.x < z.x2 and p.y > z.y1 and p.y < z.y2),
st as (select codigo, Zonas,
  {_avg_cols()}
  from zp group by codigo, Zonas)
select z.codigo, z.Zonas, round_even((z.x2 - z.x1) * (z.y2 - z.y1) / 1e4, 2) as Area,
       {", ".join("round(st." + l + ", 6) as " + l for l in FX_LAYERS)}
from fx_zones z left join st on st.codigo = z.codigo and st.Zonas = z.Zonas
"""


@register("zonal_mean", fx.oracle(_ZONE_STATS_SQL, "fx_pixels", "fx_zones"))
def q_zonal_mean(spark, sf):
    """Mean of each layer per zone, with the zone area in ha."""
    layer = zone_layer(spark, sf)
    return rounded(layer.select("codigo", "Zonas", "Area", *FX_LAYERS))


_REPORT_SQL = f"""
with r as ({_ZONE_STATS_SQL})
select codigo, Zonas, Area, Arcilla, Arena, Limo, pH from r
"""


@register("zone_report", fx.oracle(_REPORT_SQL, "fx_pixels", "fx_zones"))
def q_zone_report(spark, sf):
    """Z1 + P11/P12/P13 + O2: the per-zone soil report (``Suelos_{codigo}``)."""
    return rounded(zonal.zone_report(zone_layer(spark, sf)))


def flagship(spark, sf):
    return q_zone_report(spark, sf)


_ZONE_VALUES_SQL = """
select codigo, list_sort(list(distinct Zonas)) as zone_values
from fx_zones where Zonas is not null group by codigo
"""


@register("zone_values", fx.oracle(_ZONE_VALUES_SQL, "fx_zones"))
def q_zone_values(spark, sf):
    """Sorted distinct zone values per field."""
    return zonal.zone_values(fx.table(spark, sf, "fx_zones").select("codigo", "Zonas"))


_RASTER_ZONE_VALUES_SQL = """
select codigo, layer, list_sort(list(distinct cast(trunc(value) as int))) as zone_values
from fx_pixels where value is not null and value <> 0 and not isnan(value)
group by codigo, layer
"""


@register("raster_zone_values", fx.oracle(_RASTER_ZONE_VALUES_SQL, "fx_pixels"))
def q_raster_zone_values(spark, sf):
    """Distinct class values of every raster (nodata masked, cast to int first)."""
    px = zonal.mask_nodata(_pixels(spark, sf)).filter(F.col("value").isNotNull())
    classes = px.select("codigo", "layer", F.col("value").cast("int").alias("z")).distinct()
    return classes.groupBy("codigo", "layer").agg(F.sort_array(F.collect_list("z")).alias("zone_values"))


@register("zonal_mean_nodata", fx.oracle(_ZONE_STATS_SQL, "fx_pixels", "fx_zones"))
def q_zonal_mean_nodata(spark, sf):
    """The zone means of rasters that were written with a declared nodata sentinel."""
    path = f"{run_dir(spark)}/nodata-{uuid.uuid4().hex}"
    px = _pixels(spark, sf).select("codigo", "layer", "row", "col", "value")
    io.write_pixels(px, fx.table(spark, sf, "fx_raster_meta"), path, nodata=-9999.0)
    # read as plain tables: the operator itself masks what the metadata declares
    px, meta = spark.read.parquet(f"{path}/pixels"), spark.read.parquet(f"{path}/meta")
    px = px.withColumn("codigo", F.lpad(F.col("codigo").cast("string"), 7, "0"))  # a partition folder's name
    layer = zonal.zone_statistics(_zones(spark, sf), px, FX_LAYERS, meta)
    return rounded(layer.select("codigo", "Zonas", "Area", *FX_LAYERS))


_AREA_SQL = """
with e as (
  select a.codigo, a.x * b.y - b.x * a.y as t
  from fx_field_vertices a join fx_field_vertices b
    on a.codigo = b.codigo and a.part = b.part and a.ring = b.ring and b.seq = a.seq + 1)
select codigo, round(abs(sum(t)) / 2e0, 6) as area_m2, round(abs(sum(t)) / 2e0 / 1e4, 6) as area_ha
from e group by codigo
"""


def fields(spark, sf):
    return spatial.build_polygons(fx.table(spark, sf, "fx_field_vertices"))


@register("polygon_area", fx.oracle(_AREA_SQL, "fx_field_vertices"))
def q_polygon_area(spark, sf):
    """Field polygons from vertex rows; shoelace area in m2 and ha."""
    return rounded(spatial.polygon_area(fields(spark, sf)).select("codigo", "area_m2", "area_ha"))


_BOUNDS_SQL = """
select codigo, min(x) as xmin, min(y) as ymin, max(x) as xmax, max(y) as ymax
from fx_field_vertices group by codigo
"""


@register("field_bounds", fx.oracle(_BOUNDS_SQL, "fx_field_vertices"))
def q_field_bounds(spark, sf):
    """Bounding box of every field polygon."""
    return rounded(fields(spark, sf).select("codigo", "xmin", "ymin", "xmax", "ymax"))


_VALID_SQL = """
select codigo from fx_field_vertices group by codigo having count(*) >= 4
"""


@register("valid_polygons", fx.oracle(_VALID_SQL, "fx_field_vertices"))
def q_valid_polygons(spark, sf):
    """Closed, non-degenerate, non-self-intersecting rings only."""
    return spatial.valid_polygons(fields(spark, sf)).select("codigo")


_PARCEL_AREA_SQL = """
with e as (
  select a.codigo, a.part, a.ring, a.x * b.y - b.x * a.y as t
  from fx_parcel_vertices a join fx_parcel_vertices b
    on a.codigo = b.codigo and a.part = b.part and a.ring = b.ring and b.seq = a.seq + 1),
r as (select codigo, part, ring, abs(sum(t)) / 2e0 as a from e group by codigo, part, ring),
p as (select codigo, part, sum(case when ring = 0 then a else -a end) as a from r group by codigo, part)
"""


@register("parcel_quota", fx.oracle(_PARCEL_AREA_SQL + """
select codigo, round(sum(a) / 1e4, 6) as area_ha, greatest(cast(sum(round_even(a / 1e4 / 2.5e-1, 0)) as int), 1) as n_puntos
from p group by codigo""", "fx_parcel_vertices"))
def q_parcel_quota(spark, sf):
    """Fields of several parts and holes; the quota is rounded for each part, then summed."""
    f = spatial.polygon_area(spatial.build_polygons(fx.table(spark, sf, "fx_parcel_vertices")))
    return rounded(sampling.sampling_quota(f, 0.25).select("codigo", "area_ha", "n_puntos"))


_PARCEL_VALID_SQL = """
with e as (
  select a.codigo, a.part, a.ring, a.seq, a.x as ax, a.y as ay, b.x as bx, b.y as by
  from fx_parcel_vertices a join fx_parcel_vertices b
    on a.codigo = b.codigo and a.part = b.part and a.ring = b.ring and b.seq = a.seq + 1),
x as (
  select distinct p.codigo from e p join e q
    on p.codigo = q.codigo and p.part = q.part and p.ring = q.ring and q.seq > p.seq
  where ((p.bx - p.ax) * (q.ay - p.ay) - (p.by - p.ay) * (q.ax - p.ax)) * ((p.bx - p.ax) * (q.by - p.ay) - (p.by - p.ay) * (q.bx - p.ax)) < 0
    and ((q.bx - q.ax) * (p.ay - q.ay) - (q.by - q.ay) * (p.ax - q.ax)) * ((q.bx - q.ax) * (p.by - q.ay) - (q.by - q.ay) * (p.bx - q.ax)) < 0)
select distinct codigo from fx_parcel_vertices where codigo not in (select codigo from x)
"""


@register("valid_parcels", fx.oracle(_PARCEL_VALID_SQL, "fx_parcel_vertices"))
def q_valid_parcels(spark, sf):
    """Fields of several parts, without those that have a ring crossing itself."""
    return spatial.valid_polygons(spatial.build_polygons(fx.table(spark, sf, "fx_parcel_vertices"))).select("codigo")


_CLIP_SQL = """
with e as (
  select a.codigo, a.x as ax, a.y as ay, b.x as bx, b.y as by
  from fx_field_vertices a join fx_field_vertices b
    on a.codigo = b.codigo and b.seq = a.seq + 1),
c as (
  select p.codigo, p.layer, p."row", p."col", p.value,
         sum(case when ((e.ay > p.y) <> (e.by > p.y))
                   and p.x < (e.bx - e.ax) * (p.y - e.ay) / (e.by - e.ay) + e.ax then 1 else 0 end) as k
  from fx_pixels p join e on e.codigo = p.codigo
  group by p.codigo, p.layer, p."row", p."col", p.value)
select codigo, layer, "row", "col", round(value, 6) as value from c where k % 2 = 1
"""


@register("clip_pixels", fx.oracle(_CLIP_SQL, "fx_pixels", "fx_field_vertices"))
def q_clip_pixels(spark, sf):
    """Pixels whose centre lies inside the L-shaped field."""
    out = spatial.pixels_in_polygons(_pixels(spark, sf), fields(spark, sf), fx.table(spark, sf, "fx_raster_meta"))
    return rounded(out.select("codigo", "layer", "row", "col", "value"))
