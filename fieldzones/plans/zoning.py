"""Checked queries: PCA, spatial weights, Moran's I, fuzzy C-means and zone outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldzones import fixtures as fx
from fieldzones.functions.numeric import argmax
from fieldzones.operators import fcm, moran, raster, stats
from fieldzones.plans.registry import register, rounded
from fieldzones.session import cut_lineage

# The eight variables of the multivariate zoning step.
ZONING_VARS = ["Arcilla", "Limo", "Arena", "pH", "MO", "Na", "Ca", "CIC"]
THREE = ["Arcilla", "Limo", "Arena"]
RADIUS = 50.0


def multivar(spark, sf):
    return fx.table(spark, sf, "fx_multivar")


def _std(spark, sf):
    """Standardised variables, checkpointed: PCA reads them twice (moments, then scores)."""
    m = multivar(spark, sf)
    return cut_lineage(stats.standardise(stats.impute_mean(m, ZONING_VARS), ZONING_VARS))


def _pairs_sql(cols):
    return ", ".join(f"covar_samp(z.{a}, z.{b}) as c_{i}_{j}"
                     for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i)


_STD_CTE = """
with zs as (select codigo, pid, x, y, """ + ", ".join(
    f"(coalesce({v}, avg({v}) over (partition by codigo)) - avg({v}) over (partition by codigo)) "
    f"/ case when stddev_pop({v}) over (partition by codigo) = 0 then 1e0 else stddev_pop({v}) over (partition by codigo) end as {v}"
    for v in ZONING_VARS) + """ from fx_multivar)
"""

_COV_SQL = _STD_CTE + "select codigo, count(*) as n, " + ", ".join(
    f"round(covar_samp({a}, {b}), 6) as c_{i}_{j}"
    for i, a in enumerate(ZONING_VARS) for j, b in enumerate(ZONING_VARS) if j >= i) + " from zs group by codigo"


@register("pca_covariance", fx.oracle(_COV_SQL, "fx_multivar"))
def q_pca_covariance(spark, sf):
    """M1/M2 (distributed core): covariance of standardised variables per field."""
    return rounded(stats.covariance(_std(spark, sf), ZONING_VARS))


@register("pca_fit")
def q_pca_fit(spark, sf):
    """Eigen-decomposition per field; ratios, cumulative %, loadings (rows check)."""
    fit = stats.pca_fit(_std(spark, sf), ZONING_VARS)
    return rounded(fit.select("codigo", "k", "eigenvalue", "ratio", "cumulative"))


@register("pca_residuals", fx.oracle(f"""
select codigo, cast(k as int) as k, 0e0 as residual, 1e0 as norm
from (select distinct codigo from fx_multivar) f, range(1, {len(ZONING_VARS) + 1}) r(k)""", "fx_multivar"))
def q_pca_residuals(spark, sf):
    """M2: every component is a unit vector with covariance * vector = eigenvalue * vector."""
    z, p = _std(spark, sf), len(ZONING_VARS)
    fit = stats.pca_fit(z, ZONING_VARS)
    c = lambda i, j: F.coalesce(f"c_{min(i, j)}_{max(i, j)}", F.lit(0.0))
    rows = F.array(*[F.array(*[c(i, j) for j in range(p)]) for i in range(p)])
    m = stats.covariance(z, ZONING_VARS).select("codigo", rows.alias("m"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    off = F.transform("m", lambda row, i: F.abs(dot(row, F.col("component")) - F.col("eigenvalue") * F.get("component", i)))
    out = fit.join(m, "codigo").select("codigo", "k", F.array_max(off).alias("residual"), dot(F.col("component"), F.col("component")).alias("norm"))
    return rounded(out)


def pca_scores(spark, sf):
    z = _std(spark, sf)
    fit = stats.pca_fit(z, ZONING_VARS)
    return stats.pca_transform(z, fit, ZONING_VARS, 3), fit


@register("pca_scores")
def q_pca_scores(spark, sf):
    """M3: scores on the first three components for every point (rows check)."""
    sc, _ = pca_scores(spark, sf)
    return rounded(sc.select("codigo", "pid", "PC1", "PC2", "PC3"))


@register("component_matrix")
def q_component_matrix(spark, sf):
    """M3: component matrix, one row per variable, columns PC1..PC3 (rows check)."""
    _, fit = pca_scores(spark, sf)
    return rounded(stats.component_matrix(fit, ZONING_VARS, 3))


_PAIRS_SQL = """
select a.codigo, a.pid as i, b.pid as j, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) as d
from fx_multivar a join fx_multivar b on a.codigo = b.codigo and a.pid <> b.pid
where sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 5e1
"""


@register("neighbour_pairs", fx.oracle(_PAIRS_SQL, "fx_multivar"))
def q_neighbour_pairs(spark, sf):
    """Distance-band neighbours (50 m, inclusive, self excluded) via bucketed equi-join."""
    return rounded(moran.neighbour_pairs(multivar(spark, sf), RADIUS))


_HIST_SQL = """
with p as (select a.codigo, a.pid as i, count(b.pid) as k
           from fx_multivar a left join fx_multivar b on a.codigo = b.codigo and a.pid <> b.pid
                and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 5e1
           group by a.codigo, a.pid)
select codigo, k, count(*) as n_points from p group by codigo, k
"""


@register("neighbour_histogram", fx.oracle(_HIST_SQL, "fx_multivar"))
def q_neighbour_histogram(spark, sf):
    """Neighbour-cardinality histogram per field (islands included)."""
    m = multivar(spark, sf)
    return moran.neighbour_histogram(m, moran.neighbour_pairs(m, RADIUS))


_MORAN_SQL = """
with e as (select a.codigo, a.pid as i, b.pid as j
           from fx_multivar a join fx_multivar b on a.codigo = b.codigo and a.pid <> b.pid
           where sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 5e1),
deg as (select codigo, i, count(*) as deg from e group by codigo, i),
z as (select m.codigo, m.pid, count(*) over (partition by m.codigo) as n, coalesce(d.deg, 0) as deg,
             m.Arcilla - avg(m.Arcilla) over (partition by m.codigo) as za,
             m.Limo - avg(m.Limo) over (partition by m.codigo) as zl
      from fx_multivar m left join deg d on d.codigo = m.codigo and d.i = m.pid),
w as (select e.codigo, 1e0 / zi.deg as wij, 1e0 / zj.deg as wji, zi.za * zj.za as pa, zi.zl * zj.zl as pl
      from e join z zi on zi.codigo = e.codigo and zi.pid = e.i join z zj on zj.codigo = e.codigo and zj.pid = e.j),
ea as (select codigo, sum(wij) as s0, sum((wij + wji) * (wij + wji)) / 2e0 as s1,
              sum(wij * pa) as ca, sum(wij * pl) as cl from w group by codigo),
inc as (select e.codigo, e.j as i, sum(1e0 / zi.deg) as win from e join z zi on zi.codigo = e.codigo and zi.pid = e.i
        group by e.codigo, e.j),
na as (select z.codigo, max(n) as n, sum(power(case when deg > 0 then 1e0 else 0e0 end + coalesce(win, 0e0), 2)) as s2,
              sum(za * za) as qa, sum(zl * zl) as ql
       from z left join inc on inc.codigo = z.codigo and inc.i = z.pid group by z.codigo),
s as (select na.*, ea.s0, ea.s1, ea.ca, ea.cl, -1e0 / (n - 1e0) as ei,
             (n * n * s1 - n * s2 + 3e0 * s0 * s0) / ((n * n - 1e0) * s0 * s0) - (1e0 / (n - 1e0)) * (1e0 / (n - 1e0)) as v
      from na left join ea on ea.codigo = na.codigo),
r as (select codigo, 'Arcilla' as variable, n / s0 * ca / qa as I, ei, v, n from s
      union all select codigo, 'Limo', n / s0 * cl / ql, ei, v, n from s)
select codigo, variable, round(I, 6) as I, round(ei, 6) as EI, round((I - ei) / sqrt(v), 6) as z_norm, n from r
"""


@register("morans_i", fx.oracle(_MORAN_SQL, "fx_multivar"))
def q_morans_i(spark, sf):
    """M4: Moran's I (row-standardised 50 m weights), expectation and normal z per field."""
    out = moran.morans_i(multivar(spark, sf), ["Arcilla", "Limo"], RADIUS)
    return rounded(out.select("codigo", "variable", "I", "EI", "z_norm", "n"))


_PERMUTED_SQL = """
with z as (select codigo, pid, x, y, count(*) over (partition by codigo) as n, row_number() over (partition by codigo order by pid) as place,
                  Arcilla - avg(Arcilla) over (partition by codigo) as za, Limo - avg(Limo) over (partition by codigo) as zl from fx_multivar),
e as (select a.codigo, a.place as i, b.place as j, 1e0 / count(*) over (partition by a.codigo, a.place) as w
      from z a join z b on a.codigo = b.codigo and a.pid <> b.pid
      where sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 5e1),
d as (select codigo, k, row_number() over (partition by codigo, k order by md5(concat_ws(':', '42', cast(k as varchar), codigo, cast(pid as varchar)))) as place, za, zl
      from z, range(1, 1000) r(k)
      union all select codigo, 0, place, za, zl from z),
s as (select e.codigo, di.k, sum(e.w) as s0, sum(e.w * di.za * dj.za) as ca, sum(e.w * di.zl * dj.zl) as cl
      from e join d di on di.codigo = e.codigo and di.place = e.i join d dj on dj.codigo = e.codigo and dj.place = e.j and dj.k = di.k
      group by e.codigo, di.k),
q as (select codigo, max(n) as n, sum(za * za) as qa, sum(zl * zl) as ql from z group by codigo),
v as (select q.codigo, n, k, n / s0 * ca / qa as ia, n / s0 * cl / ql as il from q join s on s.codigo = q.codigo),
r as (select codigo, 'Arcilla' as variable, n, k, ia as i from v union all select codigo, 'Limo', n, k, il from v),
o as (select r.codigo, r.variable, max(r.n) as n, max(t.i) as i, count(*) filter (r.i >= t.i - 1e-9) as larger
      from r join r t on t.codigo = r.codigo and t.variable = r.variable and t.k = 0 where r.k > 0 group by r.codigo, r.variable)
select codigo, variable, round(i, 6) as I, n, least(larger, 999 - larger) as n_extreme, round((least(larger, 999 - larger) + 1) / 1e3, 6) as p_sim from o
"""


@register("morans_i_permuted", fx.oracle(_PERMUTED_SQL, "fx_multivar"))
def q_morans_i_permuted(spark, sf):
    """M4: Moran's I, the number of 999 permutations at least as extreme, and the p-value from it."""
    out = moran.morans_i_permuted(multivar(spark, sf), ["Arcilla", "Limo"], RADIUS)
    return rounded(out.select("codigo", "variable", "I", "n", "n_extreme", "p_sim"))


@register("morans_i_pca")
def q_morans_i_pca(spark, sf):
    """M4 on the three PCA scores, with the analytic one-sided p-value (rows check)."""
    sc, _ = pca_scores(spark, sf)
    return rounded(moran.morans_i(sc, ["PC1", "PC2", "PC3"], RADIUS))


_LABEL_SQL = """
select codigo, pid, case when Arcilla >= Limo and Arcilla >= Arena then 0 when Limo >= Arena then 1 else 2 end as Cluster
from fx_multivar
"""


def labelled(spark, sf):
    m = multivar(spark, sf)
    return m.withColumn("Cluster", argmax(F.array(*THREE)))


@register("hard_label", fx.oracle(_LABEL_SQL, "fx_multivar"))
def q_hard_label(spark, sf):
    """Class of the greatest value (first on ties)."""
    return labelled(spark, sf).select("codigo", "pid", "Cluster")


_FCM_STEP_SQL = """
with c as (select codigo, cast(pid % 3 as int) as k, avg(Arcilla) as ca, avg(Limo) as cl, avg(Arena) as cr
           from fx_multivar group by codigo, cast(pid % 3 as int)),
d as (select m.codigo, m.pid, c.k,
             power(greatest(sqrt((m.Arcilla - c.ca) * (m.Arcilla - c.ca) + (m.Limo - c.cl) * (m.Limo - c.cl)
                                 + (m.Arena - c.cr) * (m.Arena - c.cr)), 2.220446049250313e-16), -2e0) as w
      from fx_multivar m join c on c.codigo = m.codigo),
u as (select codigo, pid, k, w / sum(w) over (partition by codigo, pid) as u from d)
select codigo, pid, round(max(case when k = 0 then u end), 6) as u0, round(max(case when k = 1 then u end), 6) as u1,
       round(max(case when k = 2 then u end), 6) as u2,
       cast(arg_max(k, u) as int) as Cluster
from u group by codigo, pid
"""


@register("fcm_step", fx.oracle(_FCM_STEP_SQL, "fx_multivar"))
def q_fcm_step(spark, sf):
    """M11 step/M14/W4: memberships (m = 2) from centres of a crisp start partition."""
    m = multivar(spark, sf).select("codigo", "pid", *THREE).withColumn("n_clusters", F.lit(3))
    init = fcm._initial_centres(m, THREE, ["codigo"], 42, "mod").withColumnRenamed("cur", "centres")
    memb = fcm.with_memberships(m, init, THREE)
    return rounded(memb.select("codigo", "pid", F.col("u")[0].alias("u0"), F.col("u")[1].alias("u1"),
                               F.col("u")[2].alias("u2"), "Cluster"))


@register("fuzzy_cmeans")
def q_fuzzy_cmeans(spark, sf):
    """Fuzzy C-means (c = 3) on the PCA scores, memberships and zone (rows check)."""
    sc, _ = pca_scores(spark, sf)
    _, memb = fcm.fuzzy_cmeans(sc, ["PC1", "PC2", "PC3"], cs=(3,))
    out = fcm.membership_columns(memb, 3)
    return rounded(out.select("codigo", "pid", "Cluster", *[f"Pertenencia_Cluster{i}" for i in range(3)]))


@register("fpc_sweep")
def q_fpc_sweep(spark, sf):
    """FPC for c = 2..5 in one job per round, and the chosen c (rows check)."""
    sc, _ = pca_scores(spark, sf)
    centres, _ = fcm.fuzzy_cmeans(sc, ["PC1", "PC2", "PC3"], cs=(2, 3, 4, 5))
    best = fcm.choose_c(centres).withColumnRenamed("n_clusters", "chosen_c")
    return rounded(centres.select("codigo", F.col("n_clusters").alias("c"), "fpc", "rounds").join(best, "codigo"))


_CELL_SQL = """
select codigo, pid, x - 5e0 as cx1, y - 5e0 as cy1, x + 5e0 as cx2, y + 5e0 as cy2 from fx_multivar
"""


@register("cell_bounds", fx.oracle(_CELL_SQL, "fx_multivar"))
def q_cell_bounds(spark, sf):
    """The 10 m square cell around each point."""
    return raster.cell_bounds(multivar(spark, sf).select("codigo", "pid", "x", "y"), 10.0) \
        .select("codigo", "pid", "cx1", "cy1", "cx2", "cy2")


_RASTER_SQL = _LABEL_SQL.join(["with l as (", """),
b as (select codigo, min(x) - 5e0 as xmin, max(y) + 5e0 as ymax,
             cast(ceil((max(x) + 5e0 - (min(x) - 5e0)) / 1e1) as int) as nc,
             cast(ceil((max(y) + 5e0 - (min(y) - 5e0)) / 1e1) as int) as nr
      from fx_multivar group by codigo),
c as (select m.codigo, m.pid, l.Cluster + 1 as klass,
             cast(trunc((b.ymax - m.y) / 1e1) as int) as "row", cast(trunc((m.x - b.xmin) / 1e1) as int) as "col", nr, nc
      from fx_multivar m join l on l.codigo = m.codigo and l.pid = m.pid join b on b.codigo = m.codigo)
select codigo, "row", "col", arg_max(klass, pid) as value from c
where "row" >= 0 and "row" < nr and "col" >= 0 and "col" < nc
group by codigo, "row", "col"
"""])


@register("rasterise_zones", fx.oracle(_RASTER_SQL, "fx_multivar"))
def q_rasterise_zones(spark, sf):
    """Zone raster (class = cluster + 1, row 0 on top, last point wins)."""
    return raster.rasterise_zones(labelled(spark, sf), 10.0)


_DISSOLVE_SQL = _LABEL_SQL.join(["with l as (", """),
b as (select codigo, min(x) as bx, min(y) as by from fx_multivar group by codigo),
c as (select m.codigo, m.pid, l.Cluster, cast(round((m.x - b.bx) / 1e1) as bigint) as ci,
             cast(round((m.y - b.by) / 1e1) as bigint) as ri
      from fx_multivar m join l on l.codigo = m.codigo and l.pid = m.pid join b on b.codigo = m.codigo),
e as (select codigo, Cluster, 'h' as k, ci as a, ri as b from c
      union all select codigo, Cluster, 'h', ci, ri + 1 from c
      union all select codigo, Cluster, 'v', ci, ri from c
      union all select codigo, Cluster, 'v', ci + 1, ri from c),
be as (select codigo, Cluster, count(*) as n_edges from
        (select codigo, Cluster, k, a, b from e group by codigo, Cluster, k, a, b having count(*) = 1) t
       group by codigo, Cluster),
ce as (select codigo, Cluster, count(*) as n_cells from c group by codigo, Cluster)
select ce.codigo, ce.Cluster, ce.n_cells * 1e2 as area_m2, be.n_edges * 1e1 as perimeter_m, be.n_edges
from ce left join be on be.codigo = ce.codigo and be.Cluster = ce.Cluster
"""])


@register("dissolve_zones", fx.oracle(_DISSOLVE_SQL, "fx_multivar"))
def q_dissolve_zones(spark, sf):
    """Cells dissolved by cluster - area, boundary edges and perimeter per zone."""
    return rounded(raster.dissolve_zones(labelled(spark, sf), 10.0))
