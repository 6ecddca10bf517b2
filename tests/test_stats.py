import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldzones.operators import fcm, forest, kriging, moran, stats

VARS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(7)
    rows = []
    for f in ("F1", "F2"):
        for i in range(120):
            a = rng.normal()
            rows.append((f, i, float(i % 12) * 10.0, float(i // 12) * 10.0, a,
                         a * 0.5 + rng.normal() * 0.1, rng.normal()))
    return spark.createDataFrame(rows, "codigo string, pid long, x double, y double, a double, b double, c double")


def test_pca_invariants(spark, cloud):
    z = stats.standardise(cloud, VARS)
    fit = stats.pca_fit(z, VARS).toPandas()
    for _, g in fit.groupby("codigo"):
        n = 120
        assert abs(g["eigenvalue"].sum() - 3 * n / (n - 1)) < 1e-9
        comps = np.array(g.sort_values("k")["component"].tolist())
        assert np.allclose(comps @ comps.T, np.eye(3), atol=1e-9)
        assert abs(g["cumulative"].max() - 100.0) < 1e-9


def test_fcm_memberships(spark, cloud):
    centres, memb = fcm.fuzzy_cmeans(cloud, VARS, cs=(2, 3))
    m = memb.toPandas()
    assert np.allclose(m["u"].apply(sum), 1.0)
    c = centres.toPandas()
    for _, r in c.iterrows():
        assert 1.0 / r["n_clusters"] - 1e-9 <= r["fpc"] <= 1.0 + 1e-9
    assert set(fcm.choose_c(centres).toPandas()["n_clusters"]) <= {2, 3}


def test_moran_positive_on_ramp(spark, cloud):
    ramp = cloud.withColumn("r", F.col("x") + F.col("y"))
    out = moran.morans_i(ramp, ["r"], 50.0).toPandas()
    assert (out["I"] > 0.5).all()
    binary = moran.morans_i(ramp, ["r"], 50.0, row_standardised=False).toPandas()
    assert (binary["I"] > 0.5).all()


def test_neighbour_pairs_match_brute_force(spark, cloud):
    pairs = moran.neighbour_pairs(cloud, 25.0).count()
    p = cloud.toPandas()
    n = 0
    for _, g in p.groupby("codigo"):
        xy = g[["x", "y"]].to_numpy()
        d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
        n += int(((d <= 25.0) & (d > 0)).sum())
    assert pairs == n


def test_kriging_exact_at_data_points(spark):
    pts = spark.createDataFrame([("F", "v", i, float(x), float(y), float(z)) for i, (x, y, z) in
                                 enumerate([(0, 0, 1.0), (30, 0, 2.0), (0, 30, 3.0), (30, 30, 5.0), (15, 40, 4.0)])],
                                "codigo string, variable string, pid long, x double, y double, value double")
    model = spark.createDataFrame([("F", "v", 0.0, 2.0, 60.0)],
                                  "codigo string, variable string, nugget double, psill double, range double")
    targets = spark.createDataFrame([("F", 0, 0.0, 0.0), ("F", 1, 30.0, 30.0), ("F", 2, 15.0, 15.0)],
                                    "codigo string, tid long, x double, y double")
    out = {r["tid"]: r["value"] for r in kriging.krige(pts, targets, model).collect()}
    assert abs(out[0] - 1.0) < 1e-9 and abs(out[1] - 5.0) < 1e-9
    assert 1.0 < out[2] < 5.0


def test_variogram_fit_recovers_sill(spark):
    h = np.linspace(5, 95, 10)
    g = kriging.spherical(h, 0.1, 2.0, 60.0)
    bins = spark.createDataFrame([("F", "v", float(a), float(b)) for a, b in zip(h, g)],
                                 "codigo string, variable string, lag double, gamma double")
    r = kriging.fit_spherical(bins).first()
    assert abs(r["nugget"] + r["psill"] - 2.1) < 0.05 and 40 < r["range"] < 80


def test_forest_importances_sum_to_one(spark, cloud):
    imp, _ = forest.rf_importance(cloud.withColumnRenamed("a", "pH"), ["pH"], ["b", "c"], num_trees=20)
    total = imp.groupBy("variable").agg(F.sum("importance")).first()[1]
    assert abs(total - 1.0) < 1e-9
    assert imp.filter(F.col("rank") == 1).first()["predictor"] == "b"


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    vals = {"A": rng.normal(size=2001), "B": rng.integers(0, 5, size=300).astype(float), "C": np.array([7.0])}
    rows = [(k, float(x)) for k, xs in vals.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, value double")
    # several ranges: group A is split by value
    out = stats.exact_quantiles(df, ["g"], [0.25, 0.5, 0.75], partitions=7).collect()
    for r in out:
        assert abs(r["quantile"] - float(np.quantile(vals[r["g"]], r["p"]))) < 1e-12


def test_fcm_local_and_distributed_paths_agree(spark, cloud, monkeypatch):
    loc, _ = fcm.fuzzy_cmeans(cloud, VARS, cs=(3,))
    monkeypatch.setattr(fcm, "LOCAL_MAX_POINTS", 10)  # force the distributed rounds
    dist, _ = fcm.fuzzy_cmeans(cloud, VARS, cs=(3,))
    a = {r["codigo"]: r for r in loc.collect()}
    b = {r["codigo"]: r for r in dist.collect()}
    for k in a:
        assert a[k]["rounds"] == b[k]["rounds"]
        assert np.allclose(np.array(a[k]["centres"]), np.array(b[k]["centres"]), atol=1e-6)
        assert abs(a[k]["fpc"] - b[k]["fpc"]) < 1e-9


def test_kmeans_local_and_distributed_paths_agree(spark, cloud, monkeypatch):
    from fieldzones.operators import sampling
    q = spark.createDataFrame([("F1", 4), ("F2", 3)], "codigo string, k int")
    pts = cloud.select("codigo", "pid", "x", "y")
    _, c1 = sampling.spatial_kmeans(pts, q)
    monkeypatch.setattr(sampling, "LOCAL_MAX_POINTS", 10)
    _, c2 = sampling.spatial_kmeans(pts, q)
    a = sorted((r["codigo"], r["cluster"], round(r["cx"], 6), round(r["cy"], 6)) for r in c1.collect())
    b = sorted((r["codigo"], r["cluster"], round(r["cx"], 6), round(r["cy"], 6)) for r in c2.collect())
    assert a == b and len(a) == 7


def test_kriging_two_data_in_closed_form(spark):
    """Two data at distance d: by symmetry the mean is theirs, and b = +-(z1 - z2) / 2 / (c0 - C(d))."""
    pts = spark.createDataFrame([("F", "v", 0.0, 0.0, 1.0), ("F", "v", 30.0, 0.0, 4.0), ("G", "v", 5.0, 5.0, 7.0)],
                                "codigo string, variable string, x double, y double, value double")
    model = spark.createDataFrame([("F", "v", 0.5, 2.0, 60.0)], "codigo string, variable string, nugget double, psill double, range double")
    targets = spark.createDataFrame([("F", 0, 10.0, 0.0), ("F", 1, 500.0, 500.0), ("F", 2, 30.0, 0.0), ("G", 3, 90.0, 5.0)],
                                    "codigo string, tid long, x double, y double")
    out = {r["tid"]: r["value"] for r in kriging.krige(pts, targets, model).collect()}
    cov = lambda d: 2.0 * (1 - 1.5 * d / 60 + 0.5 * (d / 60) ** 3) if d < 60 else 0.0
    b = (1.0 - 4.0) / 2 / (2.5 - cov(30))
    assert abs(out[0] - (2.5 + b * cov(10) - b * cov(20))) < 1e-8
    assert abs(out[1] - 2.5) < 1e-8 and abs(out[2] - 4.0) < 1e-8
    assert out[3] == 7.0  # a single datum: its constant mean


def test_fcm_more_than_eight_clusters_and_few_points(spark, cloud):
    _, memb = fcm.fuzzy_cmeans(cloud, VARS, cs=(9,))
    row = fcm.membership_columns(memb, 9).first()
    assert abs(sum(row[f"Pertenencia_Cluster{i}"] for i in range(9)) - 1) < 1e-9
    _, memb = fcm.fuzzy_cmeans(cloud.filter("pid < 2"), VARS, cs=(3,))
    assert all(len(r["u"]) == 3 for r in memb.collect())


def test_constant_set_has_a_histogram(spark):
    from fieldzones.operators import sampling
    rows = [("A", "i", d, 3.0) for d in ("Total", "Muestra") for _ in range(9)]
    long = spark.createDataFrame(rows, "codigo string, index string, Dataset string, value double")
    out = sampling.density_histogram(long).filter("Dataset = 'Total'").orderBy("bin").collect()
    assert [(r["left"], r["count"]) for r in out] == [(2.5, 0), (2.5 + 1 / 3, 9), (2.5 + 2 / 3, 0)]


def test_small_kriging_systems_are_solved_at_once(spark, monkeypatch):
    """Dense systems against the rounds of conjugate gradients, which they may not need."""
    rng = np.random.default_rng(11)
    rows = [(f, "v", float(x), float(y), float(rng.normal())) for f in "FG" for x, y in rng.integers(0, 40, (8, 2)) * 5.0]
    pts = spark.createDataFrame(rows, "codigo string, variable string, x double, y double, value double")
    model = spark.createDataFrame([(f, "v", 0.1, 2.0, 90.0) for f in "FG"], "codigo string, variable string, nugget double, psill double, range double")
    targets = spark.createDataFrame([(f, i, 13.0 * i, 200.0 - 11.0 * i) for f in "FG" for i in range(15)], "codigo string, tid long, x double, y double")
    rounds = kriging.solve_groups
    monkeypatch.setattr(kriging, "solve_groups", lambda *a: pytest.fail("no rounds for small groups"))
    near = {(r.codigo, r.tid): r.value for r in kriging.krige(pts, targets, model).collect()}
    monkeypatch.setattr(kriging, "solve_groups", rounds)
    monkeypatch.setattr(kriging, "LOCAL_NODES", 1)
    far = {(r.codigo, r.tid): r.value for r in kriging.krige(pts, targets, model).collect()}
    assert set(near) == set(far) and len(near) == 30
    assert max(abs(near[k] - far[k]) for k in near) < 1e-6
