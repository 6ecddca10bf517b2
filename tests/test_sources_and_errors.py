import os
import tempfile

import pytest
from pyspark.sql import functions as F

from fieldzones.operators import dosage, sampling, samples, spatial, zonal
from fieldzones.sources import io


def _touch(base, rel):
    p = os.path.join(base, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as fh:
        fh.write("x")


def test_discovery(spark):
    base = tempfile.mkdtemp(prefix="fz-test-")
    _touch(base, "HDA1/0010001/SHP/Muestras0010001_2024.shp")
    _touch(base, "HDA1/0010002/SHP/Muestras0010002.SHP")
    _touch(base, "HDA1/0010003/SHP/muestras0010003.shp")  # prefix is case-sensitive
    _touch(base, "HDA1/0010001/Zonas/ZM_0010001.tif")
    _touch(base, "HDA1/0010001/Zonas/ZM_0010001.shp")
    s = io.discover_samples(spark, base).toPandas()
    assert list(s["suerte"]) == ["0010001", "0010002"]
    z = io.zone_files(spark, base).toPandas()
    assert list(z["codigo"]) == ["0010001"] and z["path"][0].endswith("ZM_0010001.shp")


def test_lab_csv_blanks(spark):
    d = tempfile.mkdtemp(prefix="fz-test-")
    with open(os.path.join(d, "Suelos.csv"), "w") as fh:
        fh.write("Lab; Lote; n; cm; Arena; Arcilla; Limo; Textural; pH; MO; P; K; Na; Ca; Mg; CIC; S; Fe; Mn; Cu; Zn; B\n")
        fh.write("L1; A; 3; 0-20; 40.5; 30.25; 29.25; Franco; 6.1; 2.0; 1; 2; 3; 4; 5; 6; 7; 8; 9; 10; 11; 12\n")
    r = io.read_soil_lab(spark, d, codigo="0010001").first()
    assert r["n"] == 3 and r["Arcilla"] == 30.25 and r["Textural"] == "Franco" and r["codigo"] == "0010001"
    prof = {row["column"]: row["non_null"] for row in io.profile(io.read_soil_lab(spark, d)).collect()}
    assert prof["n"] == 1 and prof["B"] == 1


def test_layer_round_trip(spark):
    d = tempfile.mkdtemp(prefix="fz-test-")
    df = spark.createDataFrame([("A", 1, 1.0), ("B", 2, 2.0)], "codigo string, n int, v double")
    io.write_layer(df, d)
    back = io.read_table(spark, d).filter(F.col("codigo") == "B")
    assert back.count() == 1


def test_errors(spark):
    with pytest.raises(ValueError):
        sampling.sampling_quota(spark.createDataFrame([("A", 1.0)], "codigo string, area_ha double"), 0)
    z = spark.createDataFrame([("A", 10.0, 20.0)], "codigo string, x1 double, x2 double")
    with pytest.raises(ValueError):
        zonal.zone_report(z)
    zones = spatial.rectangles(spark.createDataFrame([("A", 1, 0.0, 0.0, 10.0, 10.0)],
                                                     "codigo string, Zonas int, x1 double, y1 double, x2 double, y2 double"),
                               keys=("codigo", "Zonas"))
    with pytest.raises(ValueError):
        dosage.dosage_layer(zones, "   ")
    pts = spark.createDataFrame([("p1", 1.0, 2.0)], "path string, x double, y double")
    with pytest.raises(ValueError):
        samples.unify_samples(pts, spark.createDataFrame([("p1",)], "path string"))


def test_quota_zero_raised_to_one(spark):
    q = sampling.sampling_quota(spark.createDataFrame([("A", 0.2)], "codigo string, area_ha double"), 2.5).first()
    assert q["n_puntos"] == 1 and q["quota_raised"] is True


def test_texture_aliases_and_order(spark):
    df = spark.createDataFrame([("A", 1, 5.0, 6.0, 7.0)], "codigo string, Zonas int, pH double, Arc double, Aren double")
    out = zonal.merge_texture_aliases(zonal.order_soil_columns(df))
    assert "Arc" not in out.columns and out.first()["Arcilla"] == 6.0 and out.first()["Limo"] is None
    rep = zonal.zone_report(out)
    assert rep.columns == ["codigo", "Zonas", "Area", "Arcilla", "Arena", "Limo", "pH"]


def test_zone_report_job_matches_query(spark, sf):
    import __spark_entry__ as se
    from fieldzones import fixtures as fx
    from fieldzones.plans import jobs
    from fieldzones.plans.zones import FX_LAYERS
    d = tempfile.mkdtemp(prefix="fz-test-")
    _, report, dose = jobs.zone_report_job(fx.table(spark, sf, "fx_zone_vertices"), fx.table(spark, sf, "fx_pixels"),
                                           FX_LAYERS, fx.table(spark, sf, "fx_raster_meta"), "Dosis", out=d)
    got = {(r["codigo"], r["Zonas"]): round(r["pH"], 6) for r in report.collect()}
    want = {(r["codigo"], r["Zonas"]): r["pH"] for r in se.queries()["zone_report"](spark, sf).collect()}
    assert got == want
    assert io.read_table(spark, f"{d}/dosificacion").filter(F.col("Dosis") == 0.0).count() == dose.count()
