"""Steps that have to grow no faster than their input: plan shapes, and results against plain versions."""

import contextlib
import io as _io

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldzones.operators import raster, sampling, spatial


def _plan(df) -> str:
    buf = _io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _pixels(spark, layers, n=6):
    rows = [("A", l, r, c, None if (r + c) % 5 == 0 else float(r * 10 + c + 100 * i)) for i, l in enumerate(layers) for r in range(n) for c in range(n)]
    return spark.createDataFrame(rows, "codigo string, layer string, row int, col int, value double")


def _meta(spark, rows):
    return spark.createDataFrame(rows, "codigo string, layer string, x0 double, y0 double, res_x double, res_y double, n_rows int, n_cols int")


def test_stack_shuffles_once(spark):
    out = raster.stack_layers(_pixels(spark, ["p", "q"]), ["p", "q", "none"])
    assert _plan(out).count("Exchange (") <= _plan(out).count("hashpartitioning") == 1
    got = {(r.row, r.col): (r.p, r.q, r.none) for r in out.collect()}
    assert got[0, 0] == (None, None, None) and got[1, 2] == (12.0, 112.0, None) and len(got) == 36


def test_layers_of_several_grids_are_sampled(spark):
    px = _pixels(spark, ["p", "q"]).unionByName(_pixels(spark, ["p"]).filter("row = 1"))
    meta = _meta(spark, [("A", "p", 0.0, 60.0, 10.0, 10.0, 6, 6), ("A", "q", 10.0, 60.0, 10.0, 10.0, 6, 6), ("A", "p", 0.0, 60.0, 10.0, 10.0, 6, 6)])
    pts = spark.createDataFrame([("A", 1, 25.0, 45.0), ("A", 2, 5.0, 45.0), ("A", 3, 900.0, 0.0), ("B", 4, 25.0, 45.0)], "codigo string, pid long, x double, y double")
    got = {r.pid: (r.p, r.q) for r in raster.sample_layers(pts, px, meta, ["p", "q"]).collect()}
    assert got == {1: (12.0, 111.0), 2: (10.0, None), 3: (None, None)}


def test_equal_intervals_of_a_band_are_one_row(spark):
    meta = _meta(spark, [("A", l, 0.0, 1000.0, 10.0, 10.0, 100, 20) for l in "pqr"])
    field = spatial.rectangles(spark.createDataFrame([("A", 1, 0.0, 0.0, 100.0, 1000.0)], "codigo string, Zonas int, x1 double, y1 double, x2 double, y2 double"), keys=("codigo", "Zonas"))
    assert spatial.scanline_intervals(field, meta, ("Zonas",)).count() == 300
    bands = spatial.band_intervals(field, raster.grid_ids(meta), ("Zonas",))
    assert bands.count() == 4  # rows 0-31, 32-63, 64-95, 96-99 of one grid
    assert bands.agg(F.sum(F.expr("row_hi - row_lo + 1"))).first()[0] == 100


def test_slanted_fields_with_repeated_metadata(spark):
    vertices = [("A", 1, 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (95.0, 0.0), (40.0, 93.0), (0.0, 0.0)])]
    field = spatial.build_polygons(spark.createDataFrame(vertices, "codigo string, part int, ring int, seq int, x double, y double"))
    px = _pixels(spark, ["p"], 10)
    meta = _meta(spark, [("A", "p", 0.0, 100.0, 10.0, 10.0, 10, 10)])
    inside = lambda r, c: 0 < 100 - 10 * r - 5 and (100 - 10 * r - 5) < 93 / 40 * (10 * c + 5) and (100 - 10 * r - 5) < 93 / 55 * (95 - 10 * c - 5)
    want = {(r, c) for r in range(10) for c in range(10) if inside(r, c)}
    got = spatial.pixels_in_polygons(px, field, meta).select("row", "col").collect()
    assert {(r.row, r.col) for r in got} == want and len(got) == len(want)
    assert spatial.pixels_in_polygons(px, field, meta.unionByName(meta)).count() == 2 * len(want)


def test_nearest_centre_is_the_first_minimum(spark):
    rng = np.random.default_rng(3)
    xy = np.vstack([rng.integers(0, 300, (4000, 2)) * 10.0, rng.random((1000, 2)) * 1e5])
    cur = rng.integers(0, 100, (700, 2)) * 15.0  # with equal centres and ties
    d = np.sqrt((xy[:, :1] - cur[:, 0]) ** 2 + (xy[:, 1:] - cur[:, 1]) ** 2)
    lab, dist = sampling._nearest(xy, cur)
    assert (lab == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()
    pts = spark.createDataFrame([("A", i, float(x), float(y)) for i, (x, y) in enumerate(xy[:500])] + [("B", 0, 0.0, 0.0)], "codigo string, pid long, x double, y double")
    centres = spark.createDataFrame([("A", cur.tolist())], "codigo string, C array<array<double>>")
    got = {r.pid: r.cluster for r in sampling.nearest_centre(pts, centres).collect()}
    assert got == dict(enumerate(d[:500].argmin(axis=1).tolist()))


def test_density_curve_sums_kernels_as_arrays(spark):
    rng = np.random.default_rng(5)
    value = {"Total": rng.normal(3.0, 2.0, 5000), "Muestra": rng.normal(1.0, 1.0, 40)}
    long = spark.createDataFrame([("A", "i", d, float(v)) for d, x in value.items() for v in x] + [("A", "i", "Total", None), ("A", "j", "Total", 1.0)],
                                 "codigo string, index string, Dataset string, value double").repartition(3)
    out = sampling.kde_curve(long)
    assert "ArrowExec" in _plan(out) or "MapInArrow" in _plan(out)  # not one aggregate for each evaluation point
    got = {(r.Dataset, r.t): (r.at, r.density) for r in out.collect()}
    assert len(got) == 400
    for d, x in value.items():
        h = x.std(ddof=1) * len(x) ** -0.2
        at = x.min() + np.arange(200) * (x.max() - x.min()) / 199
        want = np.exp(-0.5 * ((at[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
        assert np.allclose([got[d, t] for t in range(200)], np.column_stack([at, want]), atol=1e-9)


@pytest.mark.parametrize("shift", [5.0, 3.0])
def test_resampling_broadcasts_no_cells(spark, shift, monkeypatch):
    monkeypatch.setattr(raster, "TILE", 4)  # several tiles, with edges
    px = _pixels(spark, ["p", "q"], 11)
    meta = _meta(spark, [("A", l, 0.0, 110.0, 10.0, 10.0, 11, 11) for l in "pq"])
    target = _meta(spark, [("A", l, shift, 110.0 - shift, 10.0, 10.0, 10, 10) for l in "pq"])
    out = raster.resample(px, meta, target)
    plan = _plan(out)
    assert "CoGroup" in plan and "BroadcastNestedLoop" not in plan and "SortMergeJoin" not in plan
    value = {(r.layer, r.row, r.col): r.value for r in px.collect()}
    got = {(r.layer, r.row, r.col): r.value for r in out.collect()}
    f = shift / 10
    for layer in "pq":
        for r in range(10):
            for c in range(10):
                near = [(value[layer, r + a, c + b], (f if a else 1 - f) * (f if b else 1 - f)) for a in (0, 1) for b in (0, 1)]
                near = [(v, w) for v, w in near if v is not None]
                assert abs(got[layer, r, c] - sum(v * w for v, w in near) / sum(w for _, w in near)) < 1e-9
    assert len(got) == 200
    twice = raster.resample(px, meta.unionByName(meta), target.unionByName(target)).collect()
    assert len(twice) == 400 and all(abs(r.value - got[r.layer, r.row, r.col]) < 1e-9 for r in twice)
