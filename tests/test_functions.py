import math

from pyspark.sql import functions as F

from fieldzones.functions import crs
from fieldzones.functions.numeric import arange, argmax, linspace, round_even, to_number
from fieldzones.functions.text import blank_nan, layer_name, strip, zfill, zone_code


def _one(spark, col, rows, schema="s string"):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(col.alias("o")).collect()]


def test_zfill_pads_never_truncates(spark):
    got = _one(spark, zfill(F.col("s"), 4), [("12",), ("12345",), ("-5",), ("",), ("+7",)])
    assert got == ["0012", "12345", "-005", "0000", "+007"]


def test_strip_and_blank_nan(spark):
    assert _one(spark, strip(F.col("s")), [(" \ta b\n",)]) == ["a b"]
    assert _one(spark, blank_nan(F.col("s")), [("nan",), ("x nan",), ("",)]) == ["", "x nan", ""]


def test_to_number_is_pandas_coerce(spark):
    rows = [("-5",), ("12345",), ("nan",), ("x nan",), ("5d",), ("1_000",), (" 3 ",), ("1e5",), ("",)]
    got = _one(spark, to_number(F.col("s")), rows)
    assert got == [-5.0, 12345.0, None, None, None, None, 3.0, 1e5, None]


def test_round_half_even(spark):
    import numpy as np
    vals = [0.125, 0.135, 2.675, 1.005, 7.345]
    got = _one(spark, round_even(F.col("v"), 2), [(v,) for v in vals], "v double")
    assert got == [float(np.round(v, 2)) for v in vals]
    assert got[0] == 0.12
    assert _one(spark, round_even(F.col("v")), [(2.5,), (3.5,), (-2.5,)], "v double") == [2.0, 4.0, -2.0]


def test_arange_linspace_argmax(spark):
    df = spark.createDataFrame([(0.0, 1.0)], "a double, b double")
    assert df.select(arange("a", "b", F.lit(0.25))).first()[0] == [0.0, 0.25, 0.5, 0.75]
    assert df.select(arange("b", "a", F.lit(0.25))).first()[0] == []
    assert df.select(linspace("a", "b", F.lit(5))).first()[0] == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert df.select(linspace("a", "b", F.lit(1))).first()[0] == [0.0]
    assert df.select(argmax(F.array(F.lit(1), F.lit(3), F.lit(3)))).first()[0] == 1


def test_layer_and_zone_names(spark):
    assert _one(spark, layer_name(F.col("s")), [("/a/Raster/Out/NDVI_Pl_1.tif",)]) == ["NDVI_Pl_1"]
    assert _one(spark, layer_name(F.col("s")), [("EVI_Hist_12345.tif",)]) == ["EVI_Hist_1"]
    assert _one(spark, zone_code(F.col("s")), [("/x/Zonas/ZM_0010012_b.shp",)]) == ["0010012_b"]


def test_crs_round_trip_and_origin(spark):
    pts = [(1e6, 1e6), (1.06e6, 8.6e5), (9.2e5, 1.3e6)]
    df = spark.createDataFrame(pts, "x double, y double")
    ll = crs.transform_xy(df, "EPSG:3115", "EPSG:4326")
    o = ll.first()
    assert abs(o["x"] - (-77.07750791666666)) < 1e-9 and abs(o["y"] - 4.596200416666666) < 1e-9
    back = crs.transform_xy(ll, "EPSG:4326", "EPSG:3115").collect()
    for (x, y), r in zip(pts, back):
        assert math.hypot(r["x"] - x, r["y"] - y) < 1e-3
    # a 3 degree central-meridian shift moves easting by about 3 * 111 km near the equator
    e = crs.transform_xy(df, "EPSG:3115", "EPSG:3116").first()["x"]
    assert 600_000 < e < 700_000
