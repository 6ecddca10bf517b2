from pyspark.sql import functions as F

from fieldzones.functions import geometry as geo
from fieldzones.operators import spatial


def _ring(pts):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
HOLE = [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]


def test_point_in_polygon_with_hole(spark):
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (11.0, 5.0), (9.5, 9.5)], "x double, y double")
    poly = F.array(_ring(SQUARE), _ring(HOLE))
    got = [r[0] for r in df.select(geo.in_polygon("x", "y", poly)).collect()]
    assert got == [True, False, False, True]


def test_area_and_distance(spark):
    df = spark.range(1).select(F.array(_ring(SQUARE), _ring(HOLE)).alias("p"))
    assert df.select(geo.polygon_area("p")).first()[0] == 96.0
    d = spark.createDataFrame([(5.0, 3.0)], "x double, y double").select(
        geo.ring_distance("x", "y", _ring(SQUARE))).first()[0]
    assert d == 3.0


def test_ring_validity(spark):
    bowtie = [(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)]
    df = spark.range(1)
    assert df.select(geo.ring_is_valid(_ring(SQUARE))).first()[0] is True
    assert df.select(geo.ring_is_valid(_ring(bowtie))).first()[0] is False
    assert df.select(geo.ring_is_valid(_ring([(0, 0), (1, 1), (0, 0)]))).first()[0] is False


def test_grid_and_erosion_on_square(spark):
    verts = spark.createDataFrame([("A", 1, 0, i + 1, float(x), float(y)) for i, (x, y) in
                                   enumerate([(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)])],
                                  "codigo string, part int, ring int, seq int, x double, y double")
    f = spatial.build_polygons(verts)
    g = spatial.make_grid(f, 10.0)
    assert g.count() == 100  # upper bound excluded: 10 x 10
    inside = spatial.inside_eroded(g, f, 11.0)
    # kept: 20 <= x, y <= 80 on the 10 m lattice (distance to the edge > 11 m)
    assert inside.count() == 49
