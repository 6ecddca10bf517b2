"""Grid kriging and the permutation test against dense NumPy versions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldzones.operators import lattice, moran


def sph(h, psill, rng):
    t = h / rng
    return np.where(h < rng, psill * (1 - 1.5 * t + 0.5 * t ** 3), 0.0)


@pytest.fixture(scope="module")
def grid():
    """Two fields, one over several blocks with a hole, one small; two variables."""
    rng = np.random.default_rng(3)
    rows = []
    for code, nx, ny, hole in (("a", 75, 70, True), ("b", 9, 7, False)):
        for i in range(nx):
            for j in range(ny):
                if hole and (30 < i < 45 and 20 < j < 50 or i + j < 12 or i % 3 == 0 or j % 2 == 0):
                    continue
                for v, scale in (("p", 1.0), ("q", 20.0)):
                    rows.append((code, v, 500.0 + 10 * i, 80.0 + 10 * j, float(scale * (np.sin(i / 7) + np.cos(j / 5) + 0.2 * rng.normal()))))
    return rows


MODEL = [("a", "p", 0.05, 1.1, 140.0), ("a", "q", 0.0, 300.0, 320.0), ("b", "p", 0.0, 1.0, 55.0), ("b", "q", 0.0, 0.0, 10.0)]


@pytest.fixture(scope="module")
def solved(spark, grid):
    pts = spark.createDataFrame(grid, "codigo string, variable string, x double, y double, value double")
    model = spark.createDataFrame(MODEL, "codigo string, variable string, nugget double, psill double, range double")
    return lattice.solve_lattice(lattice.lattice_blocks(pts), model).cache()


def test_system_is_solved_within_sixty_rounds(solved, grid):
    assert solved.first().rounds < 60
    got = {(r.codigo, r.variable, round(r.x), round(r.y)): r.value for r in lattice.lattice_product(solved).collect()}
    assert len(got) == len(grid)
    assert max(abs(got[c, v, round(x), round(y)] - z) for c, v, x, y, z in grid) < 1e-6


def test_values_are_those_of_a_dense_solve(solved, grid):
    got = {(r.codigo, r.variable, r.row, r.col): r.value for r in lattice.krige_lattice(solved).collect()}
    rng = np.random.default_rng(1)
    for code, variable, nugget, psill, reach in MODEL:
        at = np.array([(x, y, z) for c, v, x, y, z in grid if (c, v) == (code, variable)])
        nx, ny = (int(round((at[:, k].max() - at[:, k].min()) / 10)) + 1 for k in (0, 1))
        keys = [k for k in got if k[:2] == (code, variable)]
        assert len(keys) == (nx - 1) * (ny - 1)
        n = len(at)
        c = sph(np.hypot(at[:, None, 0] - at[None, :, 0], at[:, None, 1] - at[None, :, 1]), psill, reach)
        c[np.diag_indices(n)] = (psill + nugget) or 1.0
        a = np.ones((n + 1, n + 1))
        a[:n, :n], a[n, n] = c, 0.0
        w = np.linalg.solve(a, np.append(at[:, 2], 0.0))
        for k in (keys[i] for i in rng.integers(0, len(keys), 20)):
            x, y = at[:, 0].min() + 10 * (k[3] + 0.5), at[:, 1].max() - 10 * (k[2] + 0.5)
            assert abs(got[k] - (sph(np.hypot(at[:, 0] - x, at[:, 1] - y), psill, reach) @ w[:n] + w[n])) < 1e-6


def test_variogram_of_all_pairs(spark, grid):
    pts = spark.createDataFrame(grid, "codigo string, variable string, x double, y double, value double")
    got = {(r.codigo, r.variable, r.lag_bin): r for r in lattice.lattice_variogram(lattice.lattice_blocks(pts)).collect()}
    for code, variable in (("a", "p"), ("b", "q")):
        at = np.array([(x, y, z) for c, v, x, y, z in grid if (c, v) == (code, variable)])
        i, j = np.triu_indices(len(at), 1)
        d = np.sqrt((at[i, 0] - at[j, 0]) ** 2 + (at[i, 1] - at[j, 1]) ** 2)
        half = 0.5 * (at[i, 2] - at[j, 2]) ** 2
        bins = np.minimum(np.floor((d - d.min()) / ((d.max() - d.min()) / 6)).astype(int), 5)
        for b in range(6):
            r, m = got[code, variable, b], bins == b
            assert r.n_pairs == m.sum() and abs(r.lag - d[m].mean()) < 1e-6 and abs(r.gamma - half[m].mean()) < 1e-8


def test_weighted_fit_finds_a_spherical_model(spark):
    lags = [20.0, 60.0, 100.0, 140.0, 180.0, 220.0]
    rows = [("a", "p", k, h, 0.3 + 2.0 * (1 - float(sph(h, 1.0, 150.0))), 100 - k) for k, h in enumerate(lags)]
    rows += [("b", "p", k, h, 5.0 - 0.01 * h, 10) for k, h in enumerate(lags)]  # falls: no partial sill
    bins = spark.createDataFrame(rows, "codigo string, variable string, lag_bin int, lag double, gamma double, n_pairs long")
    fit = {r.codigo: r for r in lattice.fit_weighted(bins).collect()}
    assert abs(fit["a"].range - 150) < 4 and abs(fit["a"].nugget - 0.3) < 0.05 and abs(fit["a"].psill - 2.0) < 0.05
    assert fit["b"].psill == 0.0 and fit["b"].nugget > 0


def test_off_lattice_point_is_an_error(spark):
    pts = spark.createDataFrame([("a", "p", 0.0, 0.0, 1.0), ("a", "p", 10.0, 3.0, 1.0)], "codigo string, variable string, x double, y double, value double")
    with pytest.raises(Exception, match="lattice"):
        lattice.lattice_blocks(pts).collect()


def test_permutations_against_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [("f", i, float(rng.uniform(0, 600)), float(rng.uniform(0, 400)), float(rng.normal())) for i in range(90)]
    rows += [("g", 0, 0.0, 0.0, 1.0), ("g", 1, 900.0, 0.0, 2.0), ("h", 0, 0.0, 0.0, 4.0), ("h", 1, 1.0, 0.0, 4.0), ("f", 99, 5.0, 5.0, None)]
    got = {r.codigo: r for r in moran.morans_i_permuted(spark.createDataFrame(rows, "codigo string, pid long, x double, y double, v double"), ["v"], 50.0, 199, 7).collect()}
    at = np.array([(x, y, v) for c, _, x, y, v in rows if c == "f" and v is not None])
    ids = [i for c, i, _, _, v in rows if c == "f" and v is not None]
    w = (np.hypot(at[:, None, 0] - at[None, :, 0], at[:, None, 1] - at[None, :, 1]) <= 50).astype(float)
    np.fill_diagonal(w, 0)
    w = w / np.maximum(w.sum(axis=1, keepdims=True), 1)

    def value(z):
        return len(z) / w.sum() * (z @ w @ z) / (z @ z)

    z = at[:, 2] - at[:, 2].mean()
    drawn = []
    for k in range(1, 200):
        order = sorted(range(len(ids)), key=lambda i: hashlib.md5(f"7:{k}:f:{ids[i]}".encode()).hexdigest())
        drawn.append(value(z[order]))
    larger = int((np.array(drawn) >= value(z)).sum())
    r = got["f"]
    assert abs(r.I - value(z)) < 1e-9 and r.n == 90 and r.n_extreme == min(larger, 199 - larger) and abs(r.p_sim - (r.n_extreme + 1) / 200) < 1e-12
    assert got["g"].I is None and got["g"].p_sim is None  # no neighbours
    assert got["h"].I is None  # no variance


def test_variogram_by_several_sheets(spark, grid, monkeypatch):
    pts = spark.createDataFrame(grid, "codigo string, variable string, x double, y double, value double")
    for most in (None, 300.0):
        monkeypatch.setattr(lattice, "SHEET", 384)
        one = {(r.codigo, r.variable, r.lag_bin): r for r in lattice.lattice_variogram(lattice.lattice_blocks(pts), max_dist=most).collect()}
        monkeypatch.setattr(lattice, "SHEET", 1)
        got = {(r.codigo, r.variable, r.lag_bin): r for r in lattice.lattice_variogram(lattice.lattice_blocks(pts), max_dist=most).collect()}
        assert set(got) == set(one)
        assert all(got[k].n_pairs == one[k].n_pairs and abs(got[k].gamma - one[k].gamma) < 1e-9 and abs(got[k].lag - one[k].lag) < 1e-9 for k in one)


def test_whole_lattices_agree_with_blocks(spark, grid, solved, monkeypatch):
    """Lattices solved in one task against rounds over blocks; a field whose range exceeds it sends no block to all others."""
    model = solved.select("codigo", "variable", (F.col("c0") - F.col("psill")).alias("nugget"), "psill", "range").distinct()
    key = lambda r: (r.codigo, r.variable, r.row, r.col)
    near = {key(r): r.value for r in lattice.krige_lattice(solved).collect()}
    monkeypatch.setattr(lattice, "LOCAL_CELLS", 0)
    pts = spark.createDataFrame(grid, "codigo string, variable string, x double, y double, value double")
    far = lattice.solve_lattice(lattice.lattice_blocks(pts), model)
    got = {key(r): r.value for r in lattice.krige_lattice(far).collect()}
    assert set(got) == set(near) and max(abs(got[k] - near[k]) for k in got) < 1e-6
    assert all(abs(r.value - r.datum) < 1e-7 for r in lattice.lattice_product(far).collect())


def test_permutations_of_small_fields_are_ranked_inside_tasks(spark, monkeypatch):
    """The same counts as by sorts, also by runs of a few permutations."""
    rng = np.random.default_rng(6)
    rows = [(c, i, float(rng.uniform(0, 300)), float(rng.uniform(0, 300)), float(rng.normal()), float(i % 5)) for c in "fg" for i in range(40)]
    pts = spark.createDataFrame(rows, "codigo string, pid long, x double, y double, v double, w double")
    found = []
    sorts = moran._dealt_by_sorts
    for limit, values in ((100, 1 << 22), (100, 1000), (0, 1 << 22)):
        monkeypatch.setattr(moran, "LOCAL_POINTS", limit)
        monkeypatch.setattr(moran, "VALUES", values)
        monkeypatch.setattr(moran, "_dealt_by_sorts", sorts if limit == 0 else lambda *a: pytest.fail("no sorts for small fields"))
        found.append({(r.codigo, r.variable): (round(r.I, 9), r.n, r.n_extreme, r.p_sim) for r in moran.morans_i_permuted(pts, ["v", "w"], 60.0, 99).collect()})
    assert len(found[0]) == 4 and found[0] == found[1] == found[2]


def test_much_nugget_and_a_long_range_take_few_rounds(spark):
    """Every node reaches every other one: neighbours alone tell little."""
    rows = [("a", "v", 10.0 * i, 10.0 * j, float(np.sin(j / 50.0)) + ((i * 7919 + j * 104729) % 13) / 3.0) for j in range(700) for i in range(12) if (i + 12 * j) % 17]
    pts = spark.createDataFrame(rows, "codigo string, variable string, x double, y double, value double")
    model = spark.createDataFrame([("a", "v", 2.0, 0.6, 6500.0)], "codigo string, variable string, nugget double, psill double, range double")
    solved = lattice.solve_lattice(lattice.lattice_blocks(pts), model).cache()
    assert solved.agg(F.max("rounds")).first()[0] <= 20
    out = lattice.lattice_product(solved).agg(F.max(F.abs(F.col("value") - F.col("datum"))), F.count(F.lit(1))).first()
    assert out[0] < 1e-8 and out[1] == len(rows)


def test_values_of_a_node_are_averaged_whatever_their_last_digits(spark):
    rows = [("a", "v", 0.0, 0.0, 1.0), ("a", "v", 1e-7, 0.0, 4.0), ("a", "v", 0.0, 0.0, 1.0), ("a", "v", 10.0, 0.0, 5.0)]
    got = lattice.lattice_blocks(spark.createDataFrame(rows, "codigo string, variable string, x double, y double, value double")).first()
    assert np.frombuffer(got["value"])[:3].tolist() == [2.0, 5.0, 0.0] and np.frombuffer(got["mask"], bool).sum() == 2


@pytest.mark.parametrize("shape, reach", [((700, 12), 9000.0), ((11, 600), 9000.0), ((900, 9), 1500.0), ((60, 41), 100.0), ((513, 1), 1e6)])
def test_sums_by_offsets_equal_the_transform(shape, reach):
    st = lattice.Stencil({"psill": 2.0, "c0": 2.5, "range": reach, "ny": shape[0], "nx": shape[1]}, 10.0)
    u = np.random.default_rng(5).normal(size=shape)
    assert np.abs(st.by_offsets(u) - st.whole(shape)(u[None])[0]).max() < 1e-10


def test_sums_by_offsets_share_products(monkeypatch):
    """Doubling the rows takes three times the products of matrices, not four times."""
    rows = []
    direct = lattice._direct
    monkeypatch.setattr(lattice, "_direct", lambda k, u: rows.append(len(u)) or direct(k, u))
    for n in (1024, 2048):
        st = lattice.Stencil({"psill": 2.0, "c0": 2.5, "range": 1e6, "ny": n, "nx": 8}, 10.0)
        st.by_offsets(np.ones((n, 8)))
    assert rows.count(64) == 81 + 243
