import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldzones import fixtures as fx
from fieldzones.functions import crs
from fieldzones.operators import raster
from fieldzones.plans import design, jobs
from fieldzones.session import checkpoint_dir, run_dir


def test_zoning_job_runs_on_two_fields(spark, sf):
    two = ["0000000", "0010001"]
    feat = design.grid_features(spark, sf).filter(F.col("codigo").isin(two)).drop("Arcilla", "Arena", "Limo", "pH")
    rows = feat.filter("pid % 3 = 0").withColumn("n", F.row_number().over(Window.partitionBy("codigo").orderBy("pid")))
    lab = rows.select("codigo", "n", (F.col("NDVI_Pl_1") * 10 + F.col("n") % 5).alias("pH"), (F.col("PROD_1") / 10).alias("MO"))
    from fieldzones.plans.zones import fields
    z = jobs.zoning_job(feat, rows.drop("pid"), lab, fields(spark, sf).filter(F.col("codigo").isin(two)), num_trees=5, max_lag=30.0)
    cells = z.kriged.groupBy("codigo", "variable").agg(F.count("*").alias("n"), F.count("value").alias("v")).collect()
    assert {r["codigo"] for r in cells} == set(two) and {r["variable"] for r in cells} == {"pH", "MO"}
    assert all(r["n"] == r["v"] > 0 for r in cells)
    assert z.zones.filter("Cluster is null").count() == 0 and z.dissolved.count() >= 2


def test_unlisted_system_raises(spark):
    df = spark.createDataFrame([(1.0, 2.0, "EPSG:9999")], "x double, y double, crs string")
    with pytest.raises(Exception, match="unlisted CRS"):
        crs.to_crs(df, "EPSG:3116", default_src="EPSG:3116").collect()


def test_dissolve_takes_the_first_value_that_is_there(spark):
    df = spark.createDataFrame([("A", 1, 0.0, 0.0, 0, None), ("A", 2, 0.0, 0.0, 0, None), ("A", 3, 10.0, 0.0, 0, "b"), ("A", 4, 20.0, 0.0, 0, "c")],
                               "codigo string, pid long, x double, y double, Cluster int, name string")
    r = raster.dissolve_zones(df, 10.0, attrs=("name",)).first()
    assert r["name"] == "b" and r["area_m2"] == 300.0 and r["n_edges"] == 8
    edges = raster.zone_boundary(df, 10.0).collect()
    assert len(edges) == 8 and min(e["x1"] for e in edges) == -5.0 and max(e["x2"] for e in edges) == 25.0


def test_intermediate_tables_go_to_the_shared_folder(spark, monkeypatch):
    assert run_dir(spark).startswith(checkpoint_dir(spark).rstrip("/"))

    class Context:
        master = "spark://host:7077"
        applicationId = "other"
        def getConf(self): return self
        def get(self, *_): return None
        def getCheckpointDir(self): return None

    class Session:
        sparkContext = Context()
        conf = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
