"""Planar geometry as higher-order column expressions.

A ring is ``ARRAY<STRUCT<x DOUBLE, y DOUBLE>>`` whose last vertex repeats the first.
A polygon is ``ARRAY<ring>`` (shell first, then holes); a multipolygon is
``ARRAY<polygon>``.  Everything stays inside whole-stage code generation: no Python
per row, no geometry library.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _edges(ring: Column):
    """Indices 0..n-2 of the edges (v[i], v[i+1]) of a closed ring."""
    return F.sequence(F.lit(0), F.greatest(F.size(ring) - 2, F.lit(0)))


def ring_crossings(px, py, ring) -> Column:
    """Number of ring edges crossed by the ray from (px, py) towards +x.

    Half-open rule on y (an edge counts when exactly one end is strictly above the point),
    which gives the even-odd point-in-polygon test.
    """
    px, py, ring = _c(px), _c(py), _c(ring)

    def step(acc, i):
        a = ring[i]
        b = ring[i + 1]
        crosses = ((a["y"] > py) != (b["y"] > py)) & (
            px < (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"])
        return acc + F.when(crosses, 1).otherwise(0)

    return F.aggregate(_edges(ring), F.lit(0), step)


def in_polygon(px, py, polygon) -> Column:
    """Even-odd containment over all rings (holes included) of one polygon."""
    px, py, polygon = _c(px), _c(py), _c(polygon)
    total = F.aggregate(polygon, F.lit(0), lambda acc, r: acc + ring_crossings(px, py, r))
    return (total % 2) == 1


def in_multipolygon(px, py, parts) -> Column:
    """Inside any part (the union of parts, U3)."""
    px, py = _c(px), _c(py)
    return F.exists(_c(parts), lambda p: in_polygon(px, py, p))


def ring_distance(px, py, ring) -> Column:
    """Shortest distance from (px, py) to the edges of a ring."""
    px, py, ring = _c(px), _c(py), _c(ring)

    def seg(i):
        a = ring[i]
        b = ring[i + 1]
        ex, ey = b["x"] - a["x"], b["y"] - a["y"]
        len2 = ex * ex + ey * ey
        t = F.when(len2 == 0, F.lit(0.0)).otherwise(
            F.least(F.lit(1.0), F.greatest(F.lit(0.0),
                                           ((px - a["x"]) * ex + (py - a["y"]) * ey) / len2)))
        dx = a["x"] + t * ex - px
        dy = a["y"] + t * ey - py
        return F.sqrt(dx * dx + dy * dy)

    return F.array_min(F.transform(_edges(ring), seg))


def polygon_distance(px, py, polygon) -> Column:
    px, py = _c(px), _c(py)
    return F.array_min(F.transform(_c(polygon), lambda r: ring_distance(px, py, r)))


def ring_signed_area(ring) -> Column:
    """Shoelace formula; positive for counter-clockwise rings."""
    ring = _c(ring)
    twice = F.aggregate(
        _edges(ring), F.lit(0.0),
        lambda acc, i: acc + (ring[i]["x"] * ring[i + 1]["y"] - ring[i + 1]["x"] * ring[i]["y"]))
    return twice / 2.0


def polygon_area(polygon) -> Column:
    """Shell area minus hole areas."""
    polygon = _c(polygon)
    holes = F.aggregate(F.slice(polygon, 2, 1 << 30), F.lit(0.0),
                        lambda acc, r: acc + F.abs(ring_signed_area(r)))
    return F.abs(ring_signed_area(polygon[0])) - holes


def multipolygon_area(parts) -> Column:
    return F.aggregate(_c(parts), F.lit(0.0), lambda acc, p: acc + polygon_area(p))


def ring_bounds(ring) -> tuple[Column, Column, Column, Column]:
    ring = _c(ring)
    xs = F.transform(ring, lambda v: v["x"])
    ys = F.transform(ring, lambda v: v["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def ring_is_valid(ring) -> Column:
    """Closed, at least four vertices (a triangle), non-zero area, no crossing edges."""
    ring = _c(ring)
    n = F.size(ring)
    closed = (ring[0]["x"] == ring[n - 1]["x"]) & (ring[0]["y"] == ring[n - 1]["y"])

    def orient(a, b, c):
        return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])

    def proper_cross(i, j):
        a, b, c, d = ring[i], ring[i + 1], ring[j], ring[j + 1]
        return ((orient(a, b, c) * orient(a, b, d)) < 0) & ((orient(c, d, a) * orient(c, d, b)) < 0)

    # non-adjacent edge pairs only; the first and last edge share the closing vertex
    crossing = F.exists(
        _edges(ring),
        lambda i: F.exists(
            F.filter(_edges(ring), lambda j: (j > i + 1) & ~((i == 0) & (j == n - 2))),
            lambda j: proper_cross(i, j)))
    return (n >= 4) & closed & (ring_signed_area(ring) != 0) & ~crossing


def vertices_to_ring(seq_col="seq", x_col="x", y_col="y") -> Column:
    """Aggregate expression: vertex rows -> ordered ring (``sort_array`` on the sequence)."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(seq_col).alias("seq"),
                                                   F.col(x_col).alias("x"),
                                                   F.col(y_col).alias("y"))))
    return F.transform(ordered, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
