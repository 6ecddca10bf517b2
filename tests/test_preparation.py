"""The raster preparation chain: grids, missing inputs, fields without the reference layer."""

import re

import pytest
from pyspark.sql import functions as F

from fieldzones.functions import crs
from fieldzones.operators import preparation, raster
from fieldzones.plans import preparation as plans
from fieldzones.plans.zones import fields


def test_missing_inputs_and_reference(spark, sf):
    px, meta, plan = plans.inputs(spark, sf)
    some = plan.filter(F.col("codigo").isin("0000000", "0010001", "0030003"))
    out, grids = preparation.prepare_layers(px, meta, some, fields(spark, sf), plans.SRC, plans.DST)
    present = {(r.codigo, r.layer) for r in some.filter("present").collect()}
    assert 0 < len(present) < some.count()
    assert {(r.codigo, r.layer) for r in out.select("codigo", "layer").distinct().collect()} == present
    by = {}
    for r in grids.collect():
        by.setdefault(r.codigo, {})[r.layer] = (r.x0, r.y0, r.n_rows, r.n_cols)
    assert {(c, layer) for c in by for layer in by[c]} == present
    for code, own in by.items():  # one grid per field, unless there is no reference
        if raster.REFERENCE_LAYER in own:
            assert len(set(own.values())) == 1
        else:
            assert len(set(own.values())) > 1
    assert any(raster.REFERENCE_LAYER not in own for own in by.values())
    inside = out.groupBy("codigo", "layer").agg(F.min("row").alias("r"), F.min("col").alias("c"), F.max("row").alias("rr"), F.max("col").alias("cc")).collect()
    assert all(r.r >= 0 and r.c >= 0 and r.rr < by[r.codigo][r.layer][2] and r.cc < by[r.codigo][r.layer][3] for r in inside)


def test_gather_weighs_the_cells_that_hold_data(spark):
    wide = spark.createDataFrame([("a", "g", 0, 0, 1.0, 1.0), ("a", "g", 0, 1, 3.0, None), ("a", "g", 1, 0, 5.0, None), ("a", "g", 1, 1, 7.0, None)],
                                 "codigo string, grid string, row int, col int, p double, q double")
    meta = spark.createDataFrame([("a", "g", 0.0, 20.0, 10.0, 10.0)], "codigo string, grid string, x0 double, y0 double, res_x double, res_y double")
    targets = spark.createDataFrame([("a", "g", 0, 0, 7.5, 12.5), ("a", "g", 0, 1, 15.0, 5.0), ("a", "g", 9, 9, 500.0, 500.0)], "codigo string, grid string, row int, col int, x double, y double")
    got = {(r.row, r.col): (r.p, r.q) for r in preparation.gather(targets, wide, meta, ["p", "q"]).collect()}
    assert got == {(0, 0): (0.5625 * 1 + 0.1875 * 3 + 0.1875 * 5 + 0.0625 * 7, 1.0), (0, 1): (7.0, None)}


def test_moved_coordinates_are_compiled_code(spark, capsys):
    """The JVM compiles methods of up to 8,000 bytes: the steps stand alone, whatever is before and after them."""
    df = spark.createDataFrame([(1.06e6, 8.6e5, [1.0, 2.0])], "x double, y double, more array<double>")
    df = df.select("*", F.explode("more").alias("m")).withColumns({"x": F.col("x") + F.col("m"), "y": F.col("y") - F.col("m") * 2.5})
    df = crs.transform_xy(df, "EPSG:3116", "EPSG:3115").withColumns({"r": F.floor(F.col("x") / 10.0), "c": F.floor(F.col("y") / 10.0)})
    df.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert len(sizes) == 3 and max(sizes) <= 8000
    assert df.count() == 2


def test_layers_of_a_grid_are_resampled_side_by_side(spark):
    """Two layers share a grid, one is alone; rows of one cell are averaged, empty ones are not there."""
    meta = spark.createDataFrame([("a", n, x, 20.0, 10.0, 10.0, 2, 2) for n, x in (("p", 0.0), ("q", 0.0), ("r", 100.0))],
                                 "codigo string, layer string, x0 double, y0 double, res_x double, res_y double, n_rows int, n_cols int")
    cells = [("a", n, r, c, float(10 * r + c) + k) for k, n in enumerate("pqr") for r in (0, 1) for c in (0, 1) if (n, r, c) != ("q", 1, 1)]
    pixels = spark.createDataFrame([*cells, ("a", "p", 0, 0, 4.0), ("a", "q", 0, 1, None)], "codigo string, layer string, row int, col int, value double")
    target = meta.select("codigo", "layer", (F.col("x0") + 5.0).alias("x0"), (F.col("y0") - 5.0).alias("y0"), "res_x", "res_y", F.lit(1).alias("n_rows"), F.lit(1).alias("n_cols"))
    out = raster.resample(pixels, meta, target)
    got = {r.layer: (r.row, r.col, r.value) for r in out.collect()}
    # p: (0 + 4 + 1 + 10 + 11) / 5, q: (1 + 2 + 11) / 3, r: (2 + 3 + 12 + 13) / 4
    assert got == {"p": (0, 0, pytest.approx(26 / 5)), "q": (0, 0, pytest.approx(14 / 3)), "r": (0, 0, pytest.approx(7.5))}
