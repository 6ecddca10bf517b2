"""Forests per field: splits, importances and predictions against plain Python."""

import numpy as np
import pytest

from fieldzones.operators import field_forest as ff

P = ["EVI_Hist_1", "NDVI_Pl_1", "PROD_1", "PROD_2"]


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(4)
    rows = []
    for code, n in (("a", 40), ("b", 12), ("c", 1)):
        for i in range(n):
            x = rng.normal(size=4)
            y = 3 * x[1] + (x[2] > 0) if code == "a" else 5 * x[0]
            rows.append((code, *map(float, x), float(y), 7.0 if code == "b" else float(i)))
    rows.append(("a", 1.0, None, 0.0, 0.0, 2.0, 3.0))
    return rows, spark.createDataFrame(rows, "codigo string, " + ", ".join(f"{p} double" for p in P) + ", pH double, MO double")


def best_split(x, y):
    found = None
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for a, b in zip(v, v[1:]):
            m = x[:, f] <= a
            gain = round(y[m].sum() ** 2 / m.sum() + y[~m].sum() ** 2 / (~m).sum() - y.sum() ** 2 / len(y), 6)
            if gain > 0 and (found is None or gain > found[0]):
                found = (gain, f, (a + b) / 2)
    return found


def tree(x, y, node=1):
    s = best_split(x, y) if y.max() > y.min() else None
    if s is None:
        return {node: (None, None, y.mean())}
    m = x[:, s[1]] <= s[2]
    return {node: (s[1], s[2], y.mean())} | tree(x[m], y[m], 2 * node) | tree(x[~m], y[~m], 2 * node + 1)


def test_whole_tree_without_bootstrap(spark, train):
    rows, df = train
    grown = ff.grow(*ff.training_rows(df, ["pH"], P), None, 4, num_trees=1, max_features=4, bootstrap=False).collect()
    for code in ("a", "b", "c"):
        x = np.array([r[1:5] for r in rows if r[0] == code and None not in r], float)
        y = np.array([r[5] for r in rows if r[0] == code and None not in r])
        want = tree(x, y)
        got = {r.node: (r.f, r.threshold, r.value) for r in grown if r.codigo == code}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k][0] == want[k][0] and got[k][2] == pytest.approx(want[k][2]) and got[k][1] == pytest.approx(want[k][1])


def test_importances_selection_and_prediction(spark, train):
    rows, df = train
    forests = ff.fit(df, ["pH", "MO", "Arcilla"], P, num_trees=60)
    imp = {}
    for r in forests.importances.collect():
        imp.setdefault((r.codigo, r.variable), {})[r.predictor] = r.importance
    assert set(imp) == {(c, v) for c in "abc" for v in ("pH", "MO")}
    assert sum(imp["a", "pH"].values()) == pytest.approx(1) and max(imp["a", "pH"], key=imp["a", "pH"].get) == "NDVI_Pl_1"
    assert max(imp["b", "pH"], key=imp["b", "pH"].get) == "EVI_Hist_1"
    assert set(imp["b", "MO"].values()) == {0.0} and set(imp["c", "pH"].values()) == {0.0}
    low = {(r.codigo, r.variable, r.f) for r in forests.nodes.collect() if r.f is not None}
    assert all(imp[c, v][P[f]] > ff.THRESHOLD for c, v, f in low)
    # every point walks its own field's trees
    rng = np.random.default_rng(6)
    points = [(c, i, *map(float, rng.normal(size=4))) for c in "abcd" for i in range(30)]
    points[3] = (*points[3][:2], None, *points[3][3:])
    grid = spark.createDataFrame(points, "codigo string, pid long, " + ", ".join(f"{p} double" for p in P))
    got = {(r.codigo, r.pid, r.variable): r.value for r in ff.predict(grid, forests).collect()}
    assert len(got) == 3 * 30 * 2
    nodes = {}
    for r in forests.nodes.collect():
        nodes.setdefault((r.codigo, r.variable, r.tree), {})[r.node] = r
    for c, i, *x in points[:90:7]:
        if None in x:
            continue
        for v in ("pH", "MO"):
            values = []
            for t in range(60):
                own, at = nodes[c, v, t], 1
                while own[at].f is not None:
                    at = 2 * at + (x[own[at].f] > own[at].threshold)
                values.append(own[at].value)
            assert got[c, i, v] == pytest.approx(np.mean(values))
    assert all(got["b", i, "MO"] == pytest.approx(7.0) for i in range(30))
    assert (got["a", 3, "pH"]) is not None


def test_bootstrap_draws_as_many_as_there_are_samples(spark, train):
    _, df = train
    rows, _bins = ff.training_rows(df, ["pH"], P)
    drawn = ff._drawn(rows, 50, 42, True).groupBy("codigo", "tree").agg({"w": "sum"}).collect()
    assert {(r.codigo, r["sum(w)"]) for r in drawn} == {("a", 40.0), ("b", 12.0), ("c", 1.0)} and len(drawn) == 150


def test_trees_of_small_groups_grow_inside_tasks(spark, train, monkeypatch):
    """The same nodes as by rounds over all tasks, draws and restricted predictors included."""
    _, df = train
    rows, bins = ff.training_rows(df, ["pH", "MO"], P)
    allowed = spark.createDataFrame([(c, v, fs) for c in "abc" for v, fs in (("pH", [0, 1, 2, 3]), ("MO", [1, 3]))], "codigo string, variable string, fs array<int>")
    found = []
    rounds = ff._grown_by_rounds
    for limit in (100, 0):
        monkeypatch.setattr(ff, "LOCAL_SAMPLES", limit)
        monkeypatch.setattr(ff, "_grown_by_rounds", rounds if limit == 0 else lambda *a: pytest.fail("no rounds for small groups"))
        grown = ff.grow(rows, bins, allowed, 4, num_trees=30, max_features=2)
        found.append({(r.codigo, r.variable, r.tree, r.node): r for r in grown.collect()})
    here, far = found
    assert here.keys() == far.keys() and len({k[:3] for k in here}) == 3 * 2 * 30
    for k, r in far.items():
        assert here[k].f == r.f and here[k].weight == r.weight and here[k].threshold == pytest.approx(r.threshold)
        assert here[k].value == pytest.approx(r.value) and (r.gain is None or here[k].gain == pytest.approx(r.gain, abs=2e-6))


def test_pages_of_trees_against_walks(monkeypatch):
    """Deep and uneven trees, a lone leaf, values on a threshold and missing ones."""
    rng = np.random.default_rng(8)
    f, number, left, roots = [], [], [], []
    for size in (0, 1, 5, 90, 700):
        roots.append(len(f))
        heap = {1: None}
        for _ in range(size):
            leaf = max(heap) if rng.random() < 0.3 and max(heap) < 1 << 40 else sorted(k for k in heap if heap[k] is None)[0 if rng.random() < 0.5 else -1]
            if heap[leaf] is None:
                heap[leaf] = (int(rng.integers(3)), float(rng.integers(40)))
                heap |= {2 * leaf: None, 2 * leaf + 1: None}
        order = sorted(heap)
        at = {k: roots[-1] + i for i, k in enumerate(order)}
        for k in order:
            f.append(-1 if heap[k] is None else heap[k][0])
            number.append(float(rng.normal()) if heap[k] is None else heap[k][1])
            left.append(-1 if heap[k] is None else at[2 * k])
    arrays = np.array(f, np.int16), np.array(number), np.array(left, np.int32), np.array(roots, np.int32)
    x = rng.integers(-1, 42, (5000, 3)).astype(float)
    x[::17, 1] = np.nan
    monkeypatch.setattr(ff, "STRIDE", 999)
    want = sum(ff.walk(x, *arrays[:3], r) for r in roots)
    assert np.allclose(ff.forest_sums(x, *arrays), want)
    monkeypatch.setattr(ff, "WORDS", 0)
    assert np.allclose(ff.forest_sums(x, *arrays), want)


def grown_trees(rng, sizes):
    f, number, left, roots = [], [], [], []
    for size in sizes:
        roots.append(len(f))
        own, leaves = [(-1, float(rng.normal()), -1)], [0]
        for _ in range(size):
            k = leaves.pop(int(rng.integers(len(leaves))))
            leaves += [len(own), len(own) + 1]
            own[k] = (int(rng.integers(3)), float(rng.integers(40)), len(own))
            own += [(-1, float(rng.normal()), -1)] * 2
        for c, v, child in own:
            f.append(c)
            number.append(v)
            left.append(child + roots[-1] if child >= 0 else -1)
    return np.array(f, np.int16), np.array(number), np.array(left, np.int32), np.array(roots, np.int32)


@pytest.mark.parametrize("cells, walk", [(1 << 22, 1.0), (1 << 11, 1.0), (1 << 5, 1.0), (1 << 22, 0.0)])
def test_cells_of_trees_against_walks(monkeypatch, cells, walk):
    """Whole tables, tables slice by slice, too many cells, and blocks that are cheaper to walk."""
    rng = np.random.default_rng(9)
    arrays = grown_trees(rng, (0, 1, 6, 80, 300))
    x = rng.integers(-1, 42, (4000, 3)).astype(float)
    x[::17, 1], x[::29, 0] = np.nan, np.inf
    x = x[np.argsort(x[:, 2])]
    calls, by_cells = [], ff._by_cells
    monkeypatch.setattr(ff, "_by_cells", lambda *a: calls.append(1) or by_cells(*a))
    monkeypatch.setattr(ff, "CELLS", cells)
    monkeypatch.setattr(ff, "WALK", walk)
    want = sum(ff.walk(x, *arrays[:3], r) for r in arrays[3])
    assert np.allclose(ff.block_sums(x, np.array([700, 700, 2500, 4000]), *arrays), want, rtol=0, atol=1e-12)
    assert len(calls) == (3 if walk and cells > 1 << 5 else 0)


@pytest.mark.parametrize("near", [False, True])
def test_points_stay_while_trees_pass(spark, monkeypatch, near):
    """Several runs of points, several chunks of trees held one after the other; equal pids of a field are one mean."""
    for name, value in (("NODES", 40), ("HELD", 100), ("SMALL", 30), ("RUN", 70), ("CELLS", 64)):
        monkeypatch.setattr(ff, name, value)
    rng = np.random.default_rng(10)
    rows = []
    for code, v, trees in (("a", "p", 6), ("a", "q", 3), ("b", "q", 4)):
        for t in range(trees):
            arrays = grown_trees(rng, [12])
            heap = {0: 1}
            for k, (c, n, child) in enumerate(zip(*arrays[:3])):
                if c >= 0:
                    heap |= {int(child): 2 * heap[k], int(child) + 1: 2 * heap[k] + 1}
                rows.append((code, v, t, heap[k], 1.0, float(n), int(c) if c >= 0 else None, float(n) if c >= 0 else None, None))
    nodes = spark.createDataFrame(rows, "codigo string, variable string, tree int, node long, weight double, value double, f int, threshold double, gain double")
    points = [(c, i, *map(float, rng.integers(0, 41, 3))) for c in "abc" for i in range(200)]
    x = spark.createDataFrame(points + ([] if near else [("a", 5, 1.0, 2.0, 3.0)]), "codigo string, pid long, p0 double, p1 double, p2 double")
    got = {(r.codigo, r.pid): r.v for r in ff.point_values(x, nodes, ["p", "q", "z"], ["p0", "p1", "p2"], near=near).collect()}
    own = {}
    for r in rows:
        own.setdefault((r[0], r[1], r[2]), {})[r[3]] = r

    def value(code, v, at):
        found = []
        for (c, w, _), tree in own.items():
            if (c, w) == (code, v):
                k = 1
                while tree[k][6] is not None:
                    k = 2 * k + (at[tree[k][6]] > tree[k][7])
                found.append(tree[k][5])
        return np.mean(found)

    assert set(got) == {(c, i) for c in "ab" for i in range(200)}
    for c, i, *at in points[:400]:
        want = [value(c, "p", at) if c == "a" else None, value(c, "q", at), None]
        if not near and (c, i) == ("a", 5):
            want = [np.mean([w, value(c, v, (1.0, 2.0, 3.0))]) for w, v in zip(want, "pq")] + [None]
        assert got[c, i] == [pytest.approx(w, abs=1e-12) if w is not None else None for w in want]
