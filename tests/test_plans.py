"""Plan shapes that the design relies on (checked with explain, not timings)."""

import contextlib
import io as _io

from fieldzones.operators import moran, spatial


def _plan(df) -> str:
    buf = _io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_pixel_containment_is_a_broadcast_hash_join(spark):
    pixels = spark.createDataFrame([("A", "L", r, c, float(r * 10 + c)) for r in range(20) for c in range(20)],
                                   "codigo string, layer string, row int, col int, value double")
    meta = spark.createDataFrame([("A", "L", 0.0, 200.0, 10.0, 10.0, 20, 20)],
                                 "codigo string, layer string, x0 double, y0 double, res_x double, res_y double, "
                                 "n_rows int, n_cols int")
    zones = spatial.rectangles(spark.createDataFrame([("A", 1, 0.0, 0.0, 100.0, 200.0), ("A", 2, 100.0, 0.0, 200.0, 200.0)],
                                                     "codigo string, Zonas int, x1 double, y1 double, x2 double, y2 double"),
                               keys=("codigo", "Zonas"))
    out = spatial.pixels_in_polygons(pixels, zones, meta, attrs=("Zonas",))
    plan = _plan(out)
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    counts = {r["Zonas"]: r["count"] for r in out.groupBy("Zonas").count().collect()}
    assert counts == {1: 200, 2: 200}


def test_distance_band_has_no_nested_loop(spark):
    pts = spark.createDataFrame([("A", i, float(i % 10) * 10.0, float(i // 10) * 10.0) for i in range(100)],
                                "codigo string, pid long, x double, y double")
    plan = _plan(moran.neighbour_pairs(pts, 15.0))
    assert "NestedLoop" not in plan and "Join" in plan


def test_scan_prunes_columns(spark, sf):
    from fieldzones.sources import io
    df = io.read_table(spark, f"{sf}/part.parquet").select("p_partkey").filter("p_size > 10")
    plan = _plan(df)
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan and "PushedFilters" in plan
