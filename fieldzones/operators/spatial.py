"""Polygons, containment, areas, bounds and point grids.

Polygons are small (one row per field or zone); points and pixels are large.  Two plans:

* pixels on a raster grid (the big case): the polygons are turned into per-row column
  intervals on the small side (scanline), and containment becomes an equi-join on
  ``(codigo, layer, row)`` with a column range - no geometry is evaluated per pixel and
  the join stays in generated code;
* arbitrary points: an equi-join on ``codigo`` with the polygon side broadcast after a
  bounded size check, a bounding-box pre-filter in the join condition, and the even-odd
  test as a higher-order expression.

In both the large side is never shuffled while the small side fits the broadcast bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldzones.functions import geometry as geo
from fieldzones.functions.numeric import arange, round_even
from fieldzones.operators.raster import grid_ids
from fieldzones.session import cut_lineage, join_small, parallelism

#: Raster rows that share a key when pixels meet the intervals of polygons.
BAND = 32


def build_polygons(vertices: DataFrame, keys=("codigo",)) -> DataFrame:
    """Vertex rows ``(keys, part, ring, seq, x, y)`` -> one multipolygon row per key.

    Output: keys, ``parts ARRAY<ARRAY<ring>>`` (ring 0 = shell first), and the bounding box.
    """
    keys = list(keys)
    rings = (vertices.groupBy(*keys, "part", "ring")
             .agg(geo.vertices_to_ring().alias("vertices")))
    polys = (rings.groupBy(*keys, "part")
             .agg(F.sort_array(F.collect_list(F.struct("ring", "vertices"))).alias("r"))
             .select(*keys, "part", F.transform("r", lambda s: s["vertices"]).alias("polygon")))
    multi = (polys.groupBy(*keys)
             .agg(F.sort_array(F.collect_list(F.struct("part", "polygon"))).alias("p"))
             .select(*keys, F.transform("p", lambda s: s["polygon"]).alias("parts")))
    return with_bounds(multi)


def with_bounds(polys: DataFrame, parts_col: str = "parts") -> DataFrame:
    """Bounding box of the shells of all parts: ``xmin, ymin, xmax, ymax``."""
    shells = F.transform(F.col(parts_col), lambda p: p[0])
    xs = F.flatten(F.transform(shells, lambda r: F.transform(r, lambda v: v["x"])))
    ys = F.flatten(F.transform(shells, lambda r: F.transform(r, lambda v: v["y"])))
    return polys.select("*", F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
                        F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def rectangles(df: DataFrame, keys, x1="x1", y1="y1", x2="x2", y2="y2") -> DataFrame:
    """Axis-aligned boxes -> multipolygon rows (counter-clockwise shells)."""
    def v(x, y):
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(v(x1, y1), v(x2, y1), v(x2, y2), v(x1, y2), v(x1, y1))
    rest = [c for c in df.columns if c not in (x1, y1, x2, y2)]
    return with_bounds(df.select(*rest, F.array(F.array(ring)).alias("parts")))


def valid_polygons(polys: DataFrame) -> DataFrame:
    """Keep rows whose every ring is valid; ``n_empty`` counts rows without parts."""
    ok = F.forall("parts", lambda p: F.forall(p, lambda r: geo.ring_is_valid(r)))
    return polys.filter(F.col("parts").isNotNull() & (F.size("parts") > 0) & ok)


def polygon_area(polys: DataFrame) -> DataFrame:
    """Area in m2 and ha (shoelace, holes subtracted, parts summed)."""
    area = geo.multipolygon_area("parts")
    return polys.withColumn("area_m2", area).withColumn("area_ha", F.col("area_m2") / 1e4)


def with_area_ha(polys: DataFrame, digits: int = 2) -> DataFrame:
    """``Area`` in ha rounded half-even, only when the layer has no ``Area`` column."""
    if "Area" in polys.columns:
        return polys
    return polys.withColumn("Area", round_even(geo.multipolygon_area("parts") / 1e4, digits))


def bounds(df: DataFrame, keys=("codigo",), x="x", y="y") -> DataFrame:
    """Bounding box per key (``total_bounds``)."""
    return df.groupBy(*keys).agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"),
                                 F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def make_grid(fields: DataFrame, cellsize: float = 10.0) -> DataFrame:
    """G1: regular points over each field's bounding box, upper bound excluded.

    x is the outer loop and y the inner one; ``pid = i * ny + j``.  The grid is generated
    on the executors from one row per field (two ``explode``), never on the driver.
    """
    xs = arange(F.col("xmin"), F.col("xmax"), F.lit(float(cellsize)))
    ys = arange(F.col("ymin"), F.col("ymax"), F.lit(float(cellsize)))
    g = fields.select("codigo", F.posexplode(xs).alias("i", "x"), ys.alias("ys"))
    g = g.repartition(parallelism(fields.sparkSession), "codigo", "i")  # columns over all cores
    g = g.select("codigo", "i", "x", F.size("ys").alias("ny"), F.posexplode("ys").alias("j", "y"))
    return g.select("codigo", (F.col("i").cast("long") * F.col("ny") + F.col("j")).alias("pid"),
                    "x", "y")


def _pair_with_polygons(points: DataFrame, polys: DataFrame, margin: float = 0.0) -> DataFrame:
    p = polys.withColumnRenamed("codigo", "_pc")
    cond = ((F.col("codigo") == F.col("_pc"))
            & (F.col("x") >= F.col("xmin") - margin) & (F.col("x") <= F.col("xmax") + margin)
            & (F.col("y") >= F.col("ymin") - margin) & (F.col("y") <= F.col("ymax") + margin))
    return join_small(points, p, cond, "inner").drop("_pc")


def inside_eroded(points: DataFrame, fields: DataFrame, inset: float = 11.0) -> DataFrame:
    """Points inside some part of the field eroded by ``inset`` metres.

    Erosion by a disc of radius r keeps exactly the points inside the polygon whose
    distance to every ring is greater than r, so no buffer polygon is built.
    """
    keep = F.exists("parts", lambda poly: geo.in_polygon("x", "y", poly)
                    & (geo.polygon_distance("x", "y", poly) > F.lit(float(inset))))
    pairs = _pair_with_polygons(points, fields.select("codigo", "parts", "xmin", "ymin", "xmax", "ymax"))
    return pairs.filter(keep).select(*points.columns)


def points_in_polygons(points: DataFrame, polys: DataFrame, attrs=()) -> DataFrame:
    """Points (pixel centres) inside polygons of the same ``codigo``.

    One output row per (point, containing polygon); ``attrs`` are carried from the polygons.
    """
    cols = ["codigo", "parts", "xmin", "ymin", "xmax", "ymax", *attrs]
    pairs = _pair_with_polygons(points, polys.select(*cols))
    return pairs.filter(geo.in_multipolygon("x", "y", "parts")).select(*points.columns, *attrs)


def clip_pixels(pixels: DataFrame, fields: DataFrame) -> DataFrame:
    """Pixels whose centre lies in the field polygon."""
    return points_in_polygons(pixels, fields)


def _edges(parts_col: str = "parts"):
    """Per part, all edges of all its rings as ``(ax, ay, bx, by)`` (holes included)."""
    def ring_edges(r):
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(r) - 2, F.lit(0))),
                           lambda i: F.struct(r[i]["x"].alias("ax"), r[i]["y"].alias("ay"),
                                              r[i + 1]["x"].alias("bx"), r[i + 1]["y"].alias("by")))
    return F.transform(F.col(parts_col), lambda poly: F.flatten(F.transform(poly, ring_edges)))


def scanline_intervals(polys: DataFrame, meta: DataFrame, attrs=()) -> DataFrame:
    """Cells of a raster grid whose centre lies inside each polygon, as column intervals.

    For every polygon part and every raster row crossing its bounding box, the edges cut
    by the row's centre line give sorted crossings ``s1 < s2 < ...``; the even-odd rule
    puts a centre ``xc`` inside exactly when ``s(2j-1) <= xc < s(2j)``.  The work is on the
    small polygon side (parts x rows); the output ``(codigo, layer, row, col_lo, col_hi,
    attrs)`` turns containment of every pixel into an equi-join on ``(codigo, layer, row)``
    with a column range.  Parts of a valid multipolygon do not overlap, so no cell is
    listed twice for one polygon.
    """
    return _scanlines(polys, meta, attrs).drop("part")


def _scanlines(polys: DataFrame, meta: DataFrame, attrs=()) -> DataFrame:
    """:func:`scanline_intervals` with the polygon's ``part``."""
    p = polys.select("codigo", *attrs, F.posexplode(_edges()).alias("part", "edges"), "ymin", "ymax")
    m = meta.select("codigo", "layer", "x0", "y0", "res_x", "res_y", "n_rows", "n_cols")
    j = join_small(p, m, "codigo")
    r_lo = F.greatest(F.lit(0), F.ceil((F.col("y0") - F.col("ymax")) / F.col("res_y") - 0.5).cast("int"))
    r_hi = F.least(F.col("n_rows") - 1, F.floor((F.col("y0") - F.col("ymin")) / F.col("res_y") - 0.5).cast("int"))
    j = j.filter(r_lo <= r_hi).select("*", F.explode(F.sequence(r_lo, r_hi)).alias("row"))
    yc = F.col("y0") - (F.col("row") + 0.5) * F.col("res_y")
    j = j.withColumn("yc", yc)
    cut = F.filter("edges", lambda e: (e["ay"] > F.col("yc")) != (e["by"] > F.col("yc")))
    xs = F.array_sort(F.transform(cut, lambda e: (e["bx"] - e["ax"]) * (F.col("yc") - e["ay"])
                                  / (e["by"] - e["ay"]) + e["ax"]))
    j = j.withColumn("xs", xs)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1),
                        lambda k: F.struct(F.col("xs")[2 * k].alias("a"), F.col("xs")[2 * k + 1].alias("b")))
    j = j.filter(F.size("xs") >= 2).select("codigo", *attrs, "part", "layer", "row", "x0", "res_x", "n_cols",
                                           F.explode(pairs).alias("iv"))
    lo = F.greatest(F.lit(0), F.ceil((F.col("iv.a") - F.col("x0")) / F.col("res_x") - 0.5).cast("int"))
    hi = F.least(F.col("n_cols") - 1,
                 F.ceil((F.col("iv.b") - F.col("x0")) / F.col("res_x") - 0.5).cast("int") - 1)
    return j.select("codigo", *attrs, "part", "layer", "row", lo.alias("col_lo"), hi.alias("col_hi")) \
        .filter(F.col("col_lo") <= F.col("col_hi"))


_GEOMETRY = ["x0", "y0", "res_x", "res_y", "n_rows", "n_cols"]


def band_intervals(polys: DataFrame, meta: DataFrame, attrs=()) -> DataFrame:
    """The scanline intervals for each ``grid`` of ``meta``: codigo, grid, band (``BAND`` rows), attrs, row_lo,
    row_hi, col_lo, col_hi, where equal intervals of neighbouring rows of a band are one row."""
    grids = meta.select("codigo", F.col("grid").alias("layer"), *_GEOMETRY).distinct()
    p = polys.withColumn("_poly", F.monotonically_increasing_id())
    iv = cut_lineage(_scanlines(p, grids, (*attrs, "_poly")).withColumnRenamed("layer", "grid"))
    run = F.col("row") - F.row_number().over(Window.partitionBy("_poly", "part", "grid", "col_lo", "col_hi").orderBy("row"))
    iv = iv.withColumn("run", run).groupBy("codigo", "_poly", *attrs, "part", "grid", "col_lo", "col_hi", "run", F.floor(F.col("row") / BAND).alias("band")).agg(
        F.min("row").alias("row_lo"), F.max("row").alias("row_hi"))
    return iv.select("codigo", "grid", "band", *attrs, "row_lo", "row_hi", "col_lo", "col_hi")


def pixels_in_polygons(pixels: DataFrame, polys: DataFrame, meta: DataFrame, attrs=()) -> DataFrame:
    """J4/J5 for raster pixels: one row per (pixel, containing polygon) through an equi-join
    on ``(codigo, grid, band of rows)`` with the polygon's column intervals (no per-pixel geometry).

    The intervals are worked out once for the layers of a grid, and equal ones of neighbouring rows of
    a band are one row, so that this side stays small enough to be broadcast."""
    m = cut_lineage(grid_ids(meta.select("codigo", "layer", *_GEOMETRY), _GEOMETRY))
    iv = band_intervals(polys, m, attrs)
    iv = iv.select(F.col("codigo").alias("_c"), F.col("grid").alias("_g"), F.col("band").alias("_b"), *[F.col(a).alias(f"_a_{a}") for a in attrs],
                   "row_lo", "row_hi", "col_lo", "col_hi")
    px = join_small(pixels, m.select(F.col("codigo").alias("_pc"), F.col("layer").alias("_pl"), "grid"),
                    (F.col("codigo") == F.col("_pc")) & (F.col("layer") == F.col("_pl")))
    j = join_small(px, iv, (F.col("codigo") == F.col("_c")) & (F.col("grid") == F.col("_g")) & (F.floor(F.col("row") / BAND) == F.col("_b"))
                   & F.col("row").between(F.col("row_lo"), F.col("row_hi")) & F.col("col").between(F.col("col_lo"), F.col("col_hi")))
    return j.select(*pixels.columns, *[F.col(f"_a_{a}").alias(a) for a in attrs])


_IV = "array<struct<lo:double,hi:double>>"


def _edge_terms(e):
    """Per-edge constants (independent of the grid row)."""
    ex, ey = e["bx"] - e["ax"], e["by"] - e["ay"]
    return F.struct(e["ax"].alias("ax"), e["ay"].alias("ay"), e["bx"].alias("bx"), e["by"].alias("by"),
                    ex.alias("ex"), ey.alias("ey"), (ex * ex + ey * ey).alias("l2"))


def _near_pieces(e, y, r: float):
    """The three pieces of the capsule of edge ``e`` (radius ``r``) cut by the line ``y``:
    disc at a, disc at b, band; bounds are null when a piece is empty."""
    inf = float("inf")

    def disc(cx, cy):
        dy = y - cy
        h = F.sqrt(F.lit(r * r) - dy * dy)
        ok = F.abs(dy) <= r
        return F.when(ok, cx - h), F.when(ok, cx + h)

    a_lo, a_hi = disc(e["ax"], e["ay"])
    b_lo, b_hi = disc(e["bx"], e["by"])
    dy = y - e["ay"]
    c = e["ax"] * e["ey"] + dy * e["ex"]
    rl = F.sqrt(e["l2"]) * r
    p1, p2 = (c - rl) / e["ey"], (c + rl) / e["ey"]
    flat_ok = F.abs(dy) <= r                      # horizontal edge: the band is the row itself
    t_const = dy * e["ey"] / e["l2"]
    vert_ok = (t_const >= 0) & (t_const <= 1)     # vertical edge: the row crosses the band
    q1 = e["ax"] - dy * e["ey"] / e["ex"]
    q2 = e["ax"] + (e["l2"] - dy * e["ey"]) / e["ex"]
    return F.struct(a_lo.alias("a_lo"), a_hi.alias("a_hi"), b_lo.alias("b_lo"), b_hi.alias("b_hi"),
                    (e["l2"] > 0).alias("ok"),
                    F.when(e["ey"] == 0, F.when(flat_ok, F.lit(-inf))).otherwise(F.least(p1, p2)).alias("p_lo"),
                    F.when(e["ey"] == 0, F.when(flat_ok, F.lit(inf))).otherwise(F.greatest(p1, p2)).alias("p_hi"),
                    F.when(e["ex"] == 0, F.when(vert_ok, F.lit(-inf))).otherwise(F.least(q1, q2)).alias("t_lo"),
                    F.when(e["ex"] == 0, F.when(vert_ok, F.lit(inf))).otherwise(F.greatest(q1, q2)).alias("t_hi"))


def _band(s):
    """Band piece from the pieces struct; greatest/least skip nulls, so emptiness of each
    constraint is tested explicitly."""
    both = s["ok"] & s["p_lo"].isNotNull() & s["t_lo"].isNotNull()
    lo = F.greatest(s["p_lo"], s["t_lo"])
    hi = F.least(s["p_hi"], s["t_hi"])
    good = both & (lo <= hi)
    return F.struct(F.least(s["a_lo"], s["b_lo"], F.when(good, lo)).alias("lo"),
                    F.greatest(s["a_hi"], s["b_hi"], F.when(good, hi)).alias("hi"))


def eroded_grid(fields: DataFrame, cellsize: float = 10.0, inset: float = 11.0) -> DataFrame:
    """G1 + G2 fused: exactly the points of ``make_grid`` that ``inside_eroded`` keeps,
    generated row by row from intervals instead of testing every point.

    For every field part and grid row: the even-odd crossings give the inside intervals
    ``[s1, s2)``; every edge gives the closed interval of the row within ``inset`` of it;
    the merged near-intervals are cut out, and only the remaining grid columns are
    exploded into points.  All geometry runs on the small side (parts x rows).
    """
    cs, r = float(cellsize), float(inset)
    nx = F.ceil((F.col("xmax") - F.col("xmin")) / cs).cast("int")
    ny = F.ceil((F.col("ymax") - F.col("ymin")) / cs).cast("int")
    f = fields.select("codigo", "xmin", "ymin", nx.alias("nx"), ny.alias("ny"),
                      F.posexplode(_edges()).alias("part", "edges"))
    f = f.withColumn("edges", F.transform("edges", _edge_terms))
    f = f.filter((F.col("nx") > 0) & (F.col("ny") > 0))
    g = f.select("*", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("j"))
    # one row per (field, part, grid row): spread over all cores before the geometry
    g = g.repartition(parallelism(fields.sparkSession), "codigo", "j")
    g = g.withColumn("y", F.col("ymin") + F.col("j") * F.lit(cs))
    y = F.col("y")
    cut = F.filter("edges", lambda e: (e["ay"] > y) != (e["by"] > y))
    xs = F.array_sort(F.transform(cut, lambda e: (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]))
    g = g.withColumn("xs", xs).filter(F.size("xs") >= 2)
    g = g.withColumn("pieces", F.transform("edges", lambda e: _near_pieces(e, y, r)))
    g = g.withColumn("near_all", F.transform("pieces", _band))
    near = F.array_sort(F.filter("near_all", lambda iv: iv["lo"].isNotNull()))

    def merge(acc, iv):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1),
                         F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], iv["hi"]).alias("hi"))))
        return (F.when(F.size(acc) == 0, F.array(iv))
                .when(iv["lo"] <= last["hi"], grown)
                .otherwise(F.concat(acc, F.array(iv))))

    g = g.withColumn("near", F.aggregate(near, F.array().cast(_IV), merge))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1),
                        lambda k: F.struct(F.col("xs")[2 * k].alias("a"), F.col("xs")[2 * k + 1].alias("b")))

    def pieces(p):
        rel = F.filter("near", lambda c: (c["hi"] >= p["a"]) & (c["lo"] < p["b"]))
        bnd = F.concat(F.array(p["a"]), F.flatten(F.transform(rel, lambda c: F.array(c["lo"], c["hi"]))),
                       F.array(p["b"]))
        return F.transform(F.sequence(F.lit(0), F.size(rel)),
                           lambda m: F.struct(bnd[2 * m].alias("L"), (m > 0).alias("lopen"),
                                              bnd[2 * m + 1].alias("R")))

    g = g.select("codigo", "xmin", "nx", "ny", "j", "y", F.explode(F.flatten(F.transform(pairs, pieces))).alias("pc"))

    def xi(i):
        return F.col("xmin") + i * F.lit(cs)

    L, R = F.col("pc.L"), F.col("pc.R")
    c0 = F.ceil((L - F.col("xmin")) / cs).cast("int")
    closed_lo = F.when(xi(c0) < L, c0 + 1).when(xi(c0 - 1) >= L, c0 - 1).otherwise(c0)
    o0 = F.floor((L - F.col("xmin")) / cs).cast("int") + 1
    open_lo = F.when(xi(o0) <= L, o0 + 1).when(xi(o0 - 1) > L, o0 - 1).otherwise(o0)
    h0 = F.ceil((R - F.col("xmin")) / cs).cast("int") - 1
    hi = F.when(xi(h0) >= R, h0 - 1).when(xi(h0 + 1) < R, h0 + 1).otherwise(h0)
    lo = F.greatest(F.lit(0), F.when(F.col("pc.lopen"), open_lo).otherwise(closed_lo))
    hi = F.least(F.col("nx") - 1, hi)
    g = g.select("codigo", "xmin", "ny", "j", "y", lo.alias("i_lo"), hi.alias("i_hi")) \
        .filter(F.col("i_lo") <= F.col("i_hi"))
    pts = g.select("codigo", "xmin", "ny", "j", "y", F.explode(F.sequence("i_lo", "i_hi")).alias("i"))
    return pts.select("codigo", (F.col("i").cast("long") * F.col("ny") + F.col("j")).alias("pid"),
                      xi(F.col("i")).alias("x"), "y")
