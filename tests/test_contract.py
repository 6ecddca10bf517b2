import duckdb
import pytest

import __spark_entry__ as se
from fieldzones import fixtures

FAST = ["zone_report", "zonal_mean", "polygon_area", "field_bounds", "zone_values", "chronology_codigo",
        "harvest_view", "unify_samples", "join_lab", "neighbour_pairs", "neighbour_histogram", "morans_i",
        "hard_label", "fcm_step", "rasterise_zones", "dissolve_zones", "stack_layers", "variogram",
        "sampling_quota", "dosage_layer", "build_layers", "lab_profile", "pca_covariance", "prepared_layers", "rf_stump",
        "variogram_full", "variogram_fit", "morans_i_permuted"]


def test_registry_consistent():
    q, o = se.queries(), se.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["codigo", "Zonas", "Area"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in fixtures.BASE_TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_oracle_matches(spark, sf, con, name):
    df = se.queries()[name](spark, sf)
    cols = df.columns
    a = sorted((tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect()), key=repr)
    rel = con.execute(se.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(dcols) == sorted(cols)
    idx = [dcols.index(c) for c in sorted(cols)]
    b = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert a == b
