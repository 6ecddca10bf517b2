"""Zone statistics and the zone report.

Plan shape: the zone polygons (small) become per-row column intervals of the raster grid;
pixels (huge, partitioned by field and layer) meet them in a broadcast hash join on
``(codigo, layer, row)`` with a column range; the mean per (field, zone, layer) is a
partial aggregate, so only a few rows per zone are shuffled.
The pivot uses an explicit layer list, and the zones are joined back so that a zone
without pixels keeps null statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldzones.session import join_small

from fieldzones.operators.spatial import pixels_in_polygons, points_in_polygons, with_area_ha

# Statistic columns of the report in agronomic order (textures first,
# with their short aliases before the full names).
SOIL_ORDER = ["Arc", "Arcilla", "Aren", "Arena", "Lim", "Limo", "pH", "MO", "CIC",
              "Ca", "Cu", "Fe", "K", "Mg", "Mn", "Na", "P", "S", "Zn", "B"]
# Fixed values: (final name, short alias) of the three texture fractions.
TEXTURES = [("Arcilla", "Arc"), ("Arena", "Aren"), ("Limo", "Lim")]
# Zone field names by priority.
ZONE_FIELDS = ["Zonas", "zona", "DN", "ID", "id"]


def mask_nodata(pixels: DataFrame, meta: DataFrame | None = None, undeclared: bool = True) -> DataFrame:
    """Value -> null when equal to the layer's nodata; without one, 0 or NaN
    (``undeclared=False``: such layers stay as they are)."""
    v = F.col("value")
    if meta is None or "nodata" not in meta.columns:
        return pixels.withColumn("value", F.when((v == 0) | F.isnan(v), None).otherwise(v)) if undeclared else pixels
    m = meta.select("codigo", "layer", F.col("nodata").alias("_nd"))
    out = join_small(pixels, m, ["codigo", "layer"], "left")
    bad = F.when(F.col("_nd").isNotNull(), v == F.col("_nd")).otherwise(((v == 0) | F.isnan(v)) if undeclared else F.lit(False))
    return out.withColumn("value", F.when(bad, None).otherwise(v)).drop("_nd")


def fill_nodata(pixels: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """null/NaN -> nodata sentinel, applied only at the raster sink."""
    v = F.col("value")
    return pixels.withColumn("value", F.when(v.isNull() | F.isnan(v), F.lit(nodata)).otherwise(v))


def pixel_centres(pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """Cell centre coordinates from the raster metadata (top-left origin, row 0 on top)."""
    m = meta.select("codigo", "layer", "x0", "y0", "res_x", "res_y")
    out = join_small(pixels, m, ["codigo", "layer"])
    return out.select(*pixels.columns,
                      (F.col("x0") + (F.col("col") + 0.5) * F.col("res_x")).alias("x"),
                      (F.col("y0") - (F.col("row") + 0.5) * F.col("res_y")).alias("y"))


def statistic_name(layer) -> F.Column:
    """Statistic column name = layer name without ``_mean``."""
    return F.replace(F.col(layer) if isinstance(layer, str) else layer, F.lit("_mean"), F.lit(""))


def zonal_mean(pixels: DataFrame, zones: DataFrame, layers: list[str],
               meta: DataFrame | None = None) -> DataFrame:
    """Mean of every layer per zone (pixel centre inside; null values ignored).

    ``pixels``: codigo, layer, row, col, value (+ x, y without ``meta``).  ``zones``: codigo,
    Zonas, parts, bounds.  With the raster ``meta`` containment is a scanline equi-join
    (no per-pixel geometry); without it, a per-point even-odd test on x, y.
    Returns zones with one column per statistic; a zone without pixels gets nulls.
    """
    names = [l.replace("_mean", "") for l in layers]
    if meta is not None:
        px = mask_nodata(pixels.select("codigo", "layer", "row", "col", "value"), meta, undeclared=False)
        inside = pixels_in_polygons(px, zones, meta, attrs=("Zonas",))
    else:
        px = pixels.select("codigo", "layer", "x", "y", "value")
        inside = points_in_polygons(px, zones, attrs=("Zonas",))
    means = (inside.withColumn("stat", statistic_name("layer"))
             .groupBy("codigo", "Zonas").pivot("stat", list(dict.fromkeys(names)))
             .agg(F.avg("value")))
    return zones.join(means, ["codigo", "Zonas"], "left")


def zone_column(columns: list[str]) -> str:
    """P10: zone field by priority, else the first column (resolved on the schema)."""
    return next((c for c in ZONE_FIELDS if c in columns), columns[0])


def zone_values(df: DataFrame, column: str | None = None) -> DataFrame:
    """Sorted distinct non-null zone values per field."""
    column = column or zone_column([c for c in df.columns if c != "codigo"])
    # the classes of a field are made distinct before they meet in one row
    classes = df.filter(F.col(column).isNotNull()).select("codigo", F.col(column).alias("_z")).distinct()
    return classes.groupBy("codigo").agg(F.sort_array(F.collect_list("_z")).alias("zone_values"))


def ensure_columns(df: DataFrame, cols, dtype: str = "double") -> DataFrame:
    """Add every missing column as null."""
    for c in cols:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(dtype))
    return df


def order_soil_columns(df: DataFrame) -> DataFrame:
    """Other columns first, then the statistics in agronomic order."""
    stats = [c for c in SOIL_ORDER if c in df.columns]
    others = [c for c in df.columns if c not in stats]
    return df.select(*[F.col(f"`{c}`") for c in others + stats])


def merge_texture_aliases(df: DataFrame) -> DataFrame:
    """``Arcilla``/``Arena``/``Limo`` from the full name, else the short alias, else null.

    The choice depends on which columns exist (schema level), not on row values.
    """
    for full, short in TEXTURES:
        if full in df.columns:
            continue
        if short in df.columns:
            df = df.withColumn(full, F.col(short))
        else:
            df = df.withColumn(full, F.lit(None).cast("double"))
    return df.drop(*[s for _, s in TEXTURES if s in df.columns])


def zone_statistics(zones: DataFrame, pixels: DataFrame, layers: list[str],
                    meta: DataFrame | None = None) -> DataFrame:
    """The zone layer with area and statistics (the layer written next to the input)."""
    z = with_area_ha(zones)
    z = zonal_mean(pixels, z, layers, meta)
    z = order_soil_columns(z)
    return merge_texture_aliases(z)


def zone_report(layer: DataFrame) -> DataFrame:
    """O2 + final projection: ``codigo, Zonas, Area`` and the present statistics, by zone."""
    if "Zonas" not in layer.columns:
        raise ValueError("zone layer has no 'Zonas' column")
    stats = [c for c in SOIL_ORDER if c in layer.columns and c not in ("Arc", "Aren", "Lim")]
    out = ensure_columns(layer, ["Area"])
    return out.select("codigo", "Zonas", "Area", *stats).orderBy("codigo", "Zonas")
