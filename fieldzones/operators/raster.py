"""Rasters as long pixel tables.

``raster_pixels(codigo, layer, row, col, value)`` with a small ``raster_meta(codigo, layer,
x0, y0, res_x, res_y, n_rows, n_cols, crs)``.  Point sampling is an equi-join on the computed
cell of a grid; bilinear resampling and alignment bring targets and cells together by tiles
of the source grid; a wide feature table is a conditional aggregate over an explicit layer list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldzones.functions import crs as crs_mod
from fieldzones.session import cut_lineage, dealt, join_small, parallelism

#: Edge of the tiles in which resampling targets meet source cells.
TILE = 128


def lookup_cells(points: DataFrame, meta: DataFrame, layers: list[str]) -> DataFrame:
    """For every point and layer, the cell holding it (``floor`` of the offset)."""
    m = meta.filter(F.col("layer").isin(layers)).select(
        "codigo", "layer", "x0", "y0", "res_x", "res_y", "n_rows", "n_cols")
    pl = join_small(points, m, "codigo", "inner")
    col = F.floor((F.col("x") - F.col("x0")) / F.col("res_x")).cast("int")
    row = F.floor((F.col("y0") - F.col("y")) / F.col("res_y")).cast("int")
    return pl.select(*points.columns, "layer", row.alias("row"), col.alias("col"),
                     "n_rows", "n_cols")


def grid_ids(meta: DataFrame, geometry=("x0", "y0", "res_x", "res_y")) -> DataFrame:
    """``meta`` with ``grid``: the layers of a field with one geometry share a number (small: a row
    for each raster)."""
    return meta.withColumn("grid", F.dense_rank().over(Window.partitionBy("codigo").orderBy(*geometry)))


def sample_layers(points: DataFrame, pixels: DataFrame, meta: DataFrame,
                  layers: list[str], keys=("codigo", "pid")) -> DataFrame:
    """Value of every layer at every point, as one column per layer (wide table).

    Points outside a raster get null.  The layers of a grid lie side by side in one row per cell before
    they are shuffled, and a point meets each grid of its field once.  The join is on the full cell
    key, so no key is hot, and the rows of a point in one grid are united where they were joined.
    """
    m = meta.filter(F.col("layer").isin(layers)).select("codigo", "layer", "x0", "y0", "res_x", "res_y").distinct()
    m = cut_lineage(grid_ids(m))
    # one value per (cell, layer): a single conditional aggregate instead of a two-phase pivot
    px = join_small(pixels.select("codigo", "layer", "row", "col", "value"), m.select("codigo", "layer", "grid"), ["codigo", "layer"])
    wide = px.groupBy("codigo", "grid", "row", "col").agg(
        *[F.max(F.when(F.col("layer") == l, F.col("value"))).alias(l) for l in layers])
    grids = m.drop("layer").distinct()
    cells = join_small(points.select(*keys, "x", "y"), grids, "codigo")
    cells = cells.select(*keys, "x", "y", "grid", F.floor((F.col("y0") - F.col("y")) / F.col("res_y")).cast("int").alias("row"),
                         F.floor((F.col("x") - F.col("x0")) / F.col("res_x")).cast("int").alias("col"))
    cell = ["codigo", "grid", "row", "col"]
    hit = cells.hint("merge").join(wide, cell, "left")  # the size of generated points is not known
    place = [*[k for k in keys if k != "codigo"], "x", "y"]
    out = hit.groupBy(*cell, *place).agg(*[F.max(l).alias(l) for l in layers])
    if not grids.groupBy("codigo").count().filter("count > 1").isEmpty():
        out = out.groupBy("codigo", *place).agg(*[F.max(l).alias(l) for l in layers])
    return out.select(*keys, "x", "y", *layers)


def stack_layers(pixels: DataFrame, layers: list[str], keys=("codigo", "row", "col")) -> DataFrame:
    """Aligned layers side by side (the raster stack): one conditional aggregate, so that the layers of
    a cell that lie together are united before the only shuffle (a pivot keeps them apart)."""
    return pixels.groupBy(*keys).agg(
        *[F.first(F.when(F.col("layer") == l, F.col("value")), ignorenulls=True).alias(l) for l in layers])


def _around(targets: DataFrame) -> DataFrame:
    """``targets`` (x, y, x0, y0, res_x, res_y) with their place among the source cells: fr, fc and the cell r0, c0."""
    t = targets.withColumns({"fc": (F.col("x") - F.col("x0")) / F.col("res_x") - 0.5, "fr": (F.col("y0") - F.col("y")) / F.col("res_y") - 0.5})
    return t.withColumns({"r0": F.floor("fr").cast("int"), "c0": F.floor("fc").cast("int")})


def bilinear_tiles(targets: DataFrame, cells: DataFrame, keys: list[str], at: list[str], names: list[str], counted: bool = False) -> DataFrame:
    """For every target (keys, at, fr, fc, r0, c0) the weighted sums of the ``names`` of the four cells
    (keys, row, col, names) around it, and the weights of those that hold data (``{name}_w``).
    ``counted``: a cell's value is the sum of ``{name}_n`` values.

    Targets and cells meet in tiles of ``TILE`` x ``TILE`` source cells: a target goes to the tile of its cell,
    a cell also to the tiles before it when it lies on their edge.  A row for each target with a
    cell around it.  Several rows of one cell are all added."""
    tile = lambda c: F.floor(c / TILE)
    edge = lambda c: F.explode(F.sequence(tile(F.col(c) - 1), tile(F.col(c))))
    group, counts = [*keys, "tr", "tc"], [f"{n}_n" for n in names] if counted else []
    t = targets.na.drop(subset=[*keys, "r0", "c0"]).select(*keys, tile(F.col("r0")).alias("tr"), tile(F.col("c0")).alias("tc"), *at, "r0", "c0", "fr", "fc")
    c = cells.na.drop(subset=[*keys, "row", "col"]).withColumn("tr", edge("row")).withColumn("tc", edge("col")).select(*group, "row", "col", *names, *counts)
    kinds, wide = {**dict(cells.dtypes), **dict(targets.dtypes)}, TILE + 1
    columns = [*keys, *at, *[x for n in names for x in (n, f"{n}_w")]]
    schema = ", ".join(f"`{k}` {kinds[k] if k in (*keys, *at) else 'double'}" for k in columns)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (len(left) and len(right)):
            out = left.select([*keys, *at]).slice(0, 0)
            for name in columns[len(keys) + len(at):]:
                out = out.append_column(name, pa.array([], pa.float64()))
            return out
        top, first = (left[c][0].as_py() * TILE for c in ("tr", "tc"))
        place = (right["row"].to_numpy() - top) * wide + right["col"].to_numpy() - first
        r0, c0, fr, fc = (left[c].to_numpy() for c in ("r0", "c0", "fr", "fc"))
        y, x = fr - r0, fc - c0
        corners = [((r0 - top + dr) * wide + c0 - first + dc, (x if dc else 1 - x) * (y if dr else 1 - y)) for dr in (0, 1) for dc in (0, 1)]
        n_cells = np.bincount(place, minlength=wide * wide)
        keep = np.flatnonzero(sum(n_cells[p] for p, _ in corners))
        corners = [(p[keep], w[keep]) for p, w in corners]
        out = left.select([*keys, *at]).take(keep)
        for n in names:
            held = right[n].is_valid().to_numpy()
            total = np.bincount(place[held], right[n].to_numpy()[held], wide * wide)
            count = np.bincount(place[held], right[f"{n}_n"].to_numpy()[held] if counted else None, wide * wide)
            for name, a in ((n, total), (f"{n}_w", count)):
                out = out.append_column(name, pa.array(sum(w * a[p] for p, w in corners)))
        return out

    return dealt(t, *group).groupBy(*group).cogroup(dealt(c, *group).groupBy(*group)).applyInArrow(run, schema)


def bilinear(targets: DataFrame, pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """Bilinear value at target points ``(codigo, layer, tid, x, y)`` from source cells.

    Each target meets its four surrounding cell centres (``bilinear_tiles``); weights are renormalised over
    the cells that hold data (null cells are skipped)."""
    m = cut_lineage(meta.select("codigo", "layer", "x0", "y0", "res_x", "res_y").withColumn("grid", F.monotonically_increasing_id()))
    t = _around(join_small(targets, m, ["codigo", "layer"]))
    px = join_small(pixels.select("codigo", "layer", "row", "col", "value").filter(F.col("value").isNotNull()), m.select("codigo", "layer", "grid"), ["codigo", "layer"])
    out = bilinear_tiles(t, px, ["codigo", "layer", "grid"], ["tid"], ["value"])
    return (out.groupBy("codigo", "layer", "tid").agg((F.sum("value") / F.sum("value_w")).alias("value"), F.sum("value_w").alias("weight"))
            .filter(F.col("weight") > 0).drop("weight"))


def target_grid(meta: DataFrame) -> DataFrame:
    """Cell centres of target rasters (one row per cell), generated on the executors."""
    g = meta.select("codigo", "layer", "x0", "y0", "res_x", "res_y",
                    F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row"), "n_cols")
    g = g.repartition(parallelism(meta.sparkSession), "codigo", "row")  # rows over all cores
    g = g.select("*", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col"))
    return g.select("codigo", "layer", "row", "col",
                    (F.col("row").cast("long") * F.col("n_cols") + F.col("col")).alias("tid"),
                    (F.col("x0") + (F.col("col") + 0.5) * F.col("res_x")).alias("x"),
                    (F.col("y0") - (F.col("row") + 0.5) * F.col("res_y")).alias("y"))


def resample(pixels: DataFrame, meta: DataFrame, target_meta: DataFrame,
             src_crs: str | None = None, dst_crs: str | None = None) -> DataFrame:
    """Pixels of ``meta`` resampled bilinearly onto the grids of ``target_meta``.

    G6 (reproject): target cells are moved back to the source system (inverse G4) first.
    G8 (align): same system, the target is a reference layer's grid.

    Layers of a field that share their source and target grid are resampled together: the target cells are
    made, moved and sent to the source cells once for all of them.
    """
    own, size = ["x0", "y0", "res_x", "res_y"], ["x0", "y0", "res_x", "res_y", "n_rows", "n_cols"]
    # small tables, a row for each raster; repeated metadata repeats its target cells
    src = meta.groupBy("codigo", "layer", *own).agg(F.count(F.lit(1)).alias("times"))
    tgt = target_meta.select("codigo", "layer", *[F.col(c).alias(f"t_{c}") for c in size])
    tgt = tgt.groupBy(*tgt.columns).agg(F.count(F.lit(1)).alias("copies"))
    pairs = cut_lineage(grid_ids(tgt.join(src, ["codigo", "layer"]), (*[f"t_{c}" for c in size], *own)))
    grids = pairs.select("codigo", "grid", *[f"t_{c}" for c in size], *own).distinct()
    pts = target_grid(grids.select("codigo", F.col("grid").alias("layer"), *[F.col(f"t_{c}").alias(c) for c in size]))
    pts = pts.select("codigo", F.col("layer").alias("grid"), "row", "col", "x", "y")
    if src_crs and dst_crs and src_crs != dst_crs:
        pts = crs_mod.transform_xy(pts, dst_crs, src_crs)
    targets = _around(join_small(pts, grids.select("codigo", "grid", *own), ["codigo", "grid"]))
    # the layers of a grid lie side by side in one row per cell before they are shuffled, by their numbers in the grid
    numbered = cut_lineage(pairs.withColumn("number", F.row_number().over(Window.partitionBy("codigo", "grid").orderBy("layer")) - 1).select("codigo", "layer", "grid", "number"))
    names = [f"v{k}" for k in range((numbered.agg(F.max("number")).first()[0] or 0) + 1)]
    px = pixels.select("codigo", "layer", "row", "col", "value").filter(F.col("value").isNotNull())
    px = join_small(px, numbered, ["codigo", "layer"])
    own = lambda k: F.when(F.col("number") == k, F.col("value").cast("double"))
    wide = px.groupBy("codigo", "grid", "row", "col").agg(*[F.sum(own(k)).alias(n) for k, n in enumerate(names)], *[F.count(own(k)).cast("double").alias(f"{n}_n") for k, n in enumerate(names)])
    out = bilinear_tiles(targets, wide, ["codigo", "grid"], ["row", "col"], names, counted=True)
    out = out.select("codigo", "grid", "row", "col", F.explode(F.array(*[F.struct(F.lit(k).alias("number"), F.col(n).alias("value"), F.col(f"{n}_w").alias("value_w")) for k, n in enumerate(names)])).alias("v"))
    out = out.select("codigo", "grid", "row", "col", "v.*").filter(F.col("value_w") > 0)
    out = join_small(out, numbered, ["codigo", "grid", "number"])
    most = pairs.groupBy("codigo", "layer").agg(F.count(F.lit(1)).alias("n"), F.max("copies").alias("copies")).agg(F.max(F.greatest("n", "copies"))).first()[0]
    if (most or 1) == 1:
        return out.select("codigo", "layer", "row", "col", (F.col("value") / F.col("value_w")).alias("value"))
    out = join_small(out, pairs.select("codigo", "layer", "grid", "t_n_cols", (F.col("times") * F.col("copies")).alias("times")), ["codigo", "layer", "grid"])
    tid = (F.col("row").cast("long") * F.col("t_n_cols") + F.col("col")).alias("tid")
    vals = out.groupBy("codigo", "layer", tid).agg((F.sum(F.col("value") * F.col("times")) / F.sum(F.col("value_w") * F.col("times"))).alias("value"))
    return target_grid(target_meta).hint("merge").join(vals, ["codigo", "layer", "tid"]).select("codigo", "layer", "row", "col", "value")


def align_meta(meta: DataFrame, reference_layer: str, layers: list[str]) -> DataFrame:
    """Metadata of ``layers`` replaced by the grid of the reference layer."""
    ref = meta.filter(F.col("layer") == reference_layer).drop("layer")
    names = meta.filter(F.col("layer").isin(layers)).select("codigo", "layer")
    return join_small(names, ref, "codigo")


def grid_meta(points: DataFrame, cellsize: float = 10.0, cell_extent: bool = False) -> DataFrame:
    """Raster origin and size from point bounds.

    ``cell_extent=False``: bounds of the points, ``int`` of the spans (kriging output).
    ``cell_extent=True``: bounds of the cells around the points, ``ceil`` (zone raster).
    """
    h = cellsize / 2.0 if cell_extent else 0.0
    b = points.groupBy("codigo").agg((F.min("x") - h).alias("xmin"), (F.min("y") - h).alias("ymin"),
                                     (F.max("x") + h).alias("xmax"), (F.max("y") + h).alias("ymax"))
    span_x = (F.col("xmax") - F.col("xmin")) / cellsize
    span_y = (F.col("ymax") - F.col("ymin")) / cellsize
    if cell_extent:
        nc, nr = F.ceil(span_x).cast("int"), F.ceil(span_y).cast("int")
    else:
        nc, nr = span_x.cast("int"), span_y.cast("int")
    return b.select("codigo", F.col("xmin").alias("x0"), F.col("ymax").alias("y0"),
                    F.lit(float(cellsize)).alias("res_x"), F.lit(float(cellsize)).alias("res_y"),
                    nr.alias("n_rows"), nc.alias("n_cols"), "xmin", "ymin", "xmax", "ymax")


def cell_bounds(df: DataFrame, res: float = 10.0) -> DataFrame:
    """The square cell around each point."""
    h = res / 2.0
    return df.withColumns({"cx1": F.col("x") - h, "cy1": F.col("y") - h,
                           "cx2": F.col("x") + h, "cy2": F.col("y") + h})


def rasterise_zones(df: DataFrame, res: float = 10.0, cluster: str = "Cluster") -> DataFrame:
    """Zone raster - class = cluster + 1, row 0 on top, out-of-range dropped.

    When several points fall in one cell the last one (greatest ``pid``) wins.
    """
    d = df.filter(F.col(cluster).isNotNull()).withColumn("klass", F.col(cluster).cast("int") + 1)
    meta = grid_meta(d, res, cell_extent=True)
    j = join_small(d, meta, "codigo")
    col = ((F.col("x") - F.col("xmin")) / res).cast("int")
    row = ((F.col("ymax") - F.col("y")) / res).cast("int")
    j = j.select("codigo", "pid", "klass", row.alias("row"), col.alias("col"), "n_rows", "n_cols")
    j = j.filter((F.col("row") >= 0) & (F.col("row") < F.col("n_rows"))
                 & (F.col("col") >= 0) & (F.col("col") < F.col("n_cols")))
    return (j.groupBy("codigo", "row", "col")
            .agg(F.max_by("klass", "pid").alias("value")))


def _lattice(df: DataFrame, res: float, cluster: str) -> DataFrame:
    """Points of a cluster with their cell (ci, ri) on the field's lattice."""
    b = df.groupBy("codigo").agg(F.min("x").alias("bx"), F.min("y").alias("by"))
    d = join_small(df.filter(F.col(cluster).isNotNull()), b, "codigo")
    return d.withColumns({"ci": F.round((F.col("x") - F.col("bx")) / res).cast("long"),
                          "ri": F.round((F.col("y") - F.col("by")) / res).cast("long")})


def zone_boundary(df: DataFrame, res: float = 10.0, cluster: str = "Cluster") -> DataFrame:
    """The boundary of each zone as edge rows ``x1, y1, x2, y2``: edges of its different
    cells that occur once."""
    d = _lattice(df, res, cluster).select("codigo", cluster, "ci", "ri", "bx", "by").distinct()
    edges = F.array(
        F.struct(F.lit("h").alias("k"), F.col("ci").alias("a"), F.col("ri").alias("b")),
        F.struct(F.lit("h").alias("k"), F.col("ci").alias("a"), (F.col("ri") + 1).alias("b")),
        F.struct(F.lit("v").alias("k"), F.col("ci").alias("a"), F.col("ri").alias("b")),
        F.struct(F.lit("v").alias("k"), (F.col("ci") + 1).alias("a"), F.col("ri").alias("b")))
    e = d.select("codigo", cluster, "bx", "by", F.explode(edges).alias("e"))
    once = e.groupBy("codigo", cluster, "bx", "by", "e").agg(F.count(F.lit(1)).alias("m")).filter("m = 1")
    x = F.col("bx") + (F.col("e.a") - 0.5) * res
    y = F.col("by") + (F.col("e.b") - 0.5) * res
    flat = F.col("e.k") == "h"
    return once.select("codigo", cluster, x.alias("x1"), y.alias("y1"), F.when(flat, x + res).otherwise(x).alias("x2"),
                       F.when(flat, y).otherwise(y + res).alias("y2"))


def dissolve_zones(df: DataFrame, res: float = 10.0, cluster: str = "Cluster",
                   attrs=()) -> DataFrame:
    """Cells dissolved by cluster - boundary edges, perimeter and area per zone.

    Points of one cell are one cell.  Other attributes take the first value (by ``pid``) that is
    not null.  The edges themselves: :func:`zone_boundary`.
    """
    d = _lattice(df, res, cluster)
    boundary = zone_boundary(df, res, cluster).groupBy("codigo", cluster).agg(F.count(F.lit(1)).alias("n_edges"))
    cells = d.select("codigo", cluster, "ci", "ri").distinct().groupBy("codigo", cluster).agg(F.count(F.lit(1)).alias("n_cells"))
    out = cells.join(boundary, ["codigo", cluster], "left")
    if attrs:
        first = d.groupBy("codigo", cluster).agg(*[F.min_by(a, F.when(F.col(a).isNotNull(), F.col("pid"))).alias(a) for a in attrs])
        out = out.join(first, ["codigo", cluster])
    return out.select("codigo", cluster, (F.col("n_cells") * (res * res)).alias("area_m2"),
                      (F.col("n_edges") * res).alias("perimeter_m"), "n_edges", *attrs)


def clip_raster(pixels: DataFrame, meta: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pixels whose centre lies in the field, cropped to the extent of the kept cells.

    Rows and columns are re-indexed from the new top-left cell; the metadata moves with them.
    """
    from fieldzones.operators.spatial import pixels_in_polygons
    kept = pixels_in_polygons(pixels.select("codigo", "layer", "row", "col", "value"), fields, meta)
    ext = kept.groupBy("codigo", "layer").agg(F.min("row").alias("r0"), F.max("row").alias("r1"),
                                               F.min("col").alias("c0"), F.max("col").alias("c1"))
    new_meta = meta.join(ext, ["codigo", "layer"]).select(
        "codigo", "layer", (F.col("x0") + F.col("c0") * F.col("res_x")).alias("x0"),
        (F.col("y0") - F.col("r0") * F.col("res_y")).alias("y0"), "res_x", "res_y",
        (F.col("r1") - F.col("r0") + 1).alias("n_rows"), (F.col("c1") - F.col("c0") + 1).alias("n_cols"))
    out = join_small(kept, ext, ["codigo", "layer"]).select(
        "codigo", "layer", (F.col("row") - F.col("r0")).alias("row"),
        (F.col("col") - F.col("c0")).alias("col"), "value")
    return out, new_meta


def default_target_meta(meta: DataFrame, src: str, dst: str) -> DataFrame:
    """Target grid for a reprojection: the bounding box of the transformed raster corners at
    the source resolution (one row per raster; the four corners are exploded and moved)."""
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    c = meta.select("codigo", "layer", "res_x", "res_y", "x0", "y0", "n_rows", "n_cols",
                    F.explode(corners).alias("k"))
    c = c.select("codigo", "layer", "res_x", "res_y",
                 (F.col("x0") + F.col("k.a") * F.col("n_cols") * F.col("res_x")).alias("x"),
                 (F.col("y0") - F.col("k.b") * F.col("n_rows") * F.col("res_y")).alias("y"))
    c = crs_mod.transform_xy(c, src, dst)
    b = c.groupBy("codigo", "layer", "res_x", "res_y").agg(
        F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))
    return b.select("codigo", "layer", F.col("xmin").alias("x0"), F.col("ymax").alias("y0"), "res_x", "res_y",
                    F.ceil((F.col("ymax") - F.col("ymin")) / F.col("res_y")).cast("int").alias("n_rows"),
                    F.ceil((F.col("xmax") - F.col("xmin")) / F.col("res_x")).cast("int").alias("n_cols"))


# Raster families of the sampling step (input prefix, output prefix).
LAYER_FAMILIES = [("NDVI_median", "NDVI_Pl"), ("EVI_median", "EVI_Hist"), ("PROD_median", "PROD")]
REFERENCE_LAYER = "NDVI_Pl_1"


def build_layers(spark, meta: DataFrame, per_family: int = 5) -> DataFrame:
    """The layer plan of every field, and whether its input raster is there.

    The input of a layer is named ``{input prefix}_{codigo}_{i}``.  All layers but the reference
    are aligned to it, so that they share one grid.  Missing inputs are reported
    (``present = false``) instead of failing the run.
    """
    plan = [F.struct(F.lit(pre).alias("pre"), F.lit(out).alias("family"), F.lit(i).alias("i"))
            for pre, out in LAYER_FAMILIES for i in range(1, per_family + 1)]
    p = meta.select("codigo").distinct().select("codigo", F.explode(F.array(*plan)).alias("p"))
    layer = F.concat_ws("_", "p.family", F.col("p.i").cast("string"))
    source = F.concat_ws("_", "p.pre", "codigo", F.col("p.i").cast("string"))
    p = p.select("codigo", layer.alias("layer"), "p.family", "p.i", source.alias("source"),
                 F.when(layer != REFERENCE_LAYER, F.lit(REFERENCE_LAYER)).alias("align_to"))
    have = meta.select("codigo", F.col("layer").alias("source"), F.lit(True).alias("present")).distinct()
    return p.join(have, ["codigo", "source"], "left").fillna(False, subset=["present"]).select(
        "codigo", "layer", "family", "i", "source", "align_to", "present")
