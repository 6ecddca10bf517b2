"""Checked queries: sampling grid, layer features and the soil-sampling design."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldzones import fixtures as fx
from fieldzones.operators import raster, sampling, spatial, stats
from fieldzones.plans.registry import register, rounded
from fieldzones.plans.zones import FX_LAYERS, fields
from fieldzones.session import cut_lineage

CELL = 10.0
INSET = 11.0
HA_PER_POINT = 0.5
INDEX_LAYERS = sorted(FX_LAYERS)
_VALUES = ", ".join(f"('{l}', {l})" for l in INDEX_LAYERS)

# DuckDB: grid over each field's bounding box, kept when inside the ring and farther than
# the inset from every edge (the same rule written independently as joins and aggregates).
_GRID_SQL = """
with b as (select codigo, min(x) as xmin, min(y) as ymin, max(x) as xmax, max(y) as ymax
           from fx_field_vertices group by codigo),
n as (select codigo, xmin, ymin, cast(ceil((xmax - xmin) / 1e1) as int) as nx,
             cast(ceil((ymax - ymin) / 1e1) as int) as ny from b),
g as (select codigo, cast(i as bigint) * ny + j as pid, xmin + i * 1e1 as x, ymin + j * 1e1 as y
      from n, range(0, nx) r1(i), range(0, ny) r2(j)),
e as (select a.codigo, a.x as ax, a.y as ay, b.x as bx, b.y as by
      from fx_field_vertices a join fx_field_vertices b on a.codigo = b.codigo and b.seq = a.seq + 1),
ge as (select g.codigo, g.pid, g.x, g.y, e.ax, e.ay, e.by as eby, e.bx - e.ax as ex, e.by - e.ay as ey
       from g join e on e.codigo = g.codigo),
gt as (select *, greatest(0e0, least(1e0, ((x - ax) * ex + (y - ay) * ey) / (ex * ex + ey * ey))) as tt from ge),
t as (select codigo, pid, x, y,
        sum(case when ((ay > y) <> (eby > y)) and x < ex * (y - ay) / (eby - ay) + ax then 1 else 0 end) as k,
        min(sqrt((ax + tt * ex - x) * (ax + tt * ex - x) + (ay + tt * ey - y) * (ay + tt * ey - y))) as d
      from gt group by codigo, pid, x, y),
grid as (select codigo, pid, x, y from t where k % 2 = 1 and d > 1.1e1)
"""


def sampling_grid(spark, sf):
    """Grid points inside the eroded field, generated row by row from intervals."""
    return spatial.eroded_grid(fields(spark, sf), CELL, INSET)


@register("sampling_grid", fx.oracle(_GRID_SQL + "select codigo, pid, round(x, 6) as x, round(y, 6) as y from grid",
                                     "fx_field_vertices"))
def q_sampling_grid(spark, sf):
    """10 m grid points inside each field eroded by 11 m."""
    return rounded(sampling_grid(spark, sf))


def _pivot_sql(layers):
    return ", ".join(f"max(case when p.layer = '{l}' then p.value end) as {l}" for l in layers)


_FEATURES_SQL = _GRID_SQL + f""",
feat as (
  select g.codigo, g.pid, g.x, g.y, {_pivot_sql(FX_LAYERS)}
  from grid g join fx_raster_meta m on m.codigo = g.codigo
  left join fx_pixels p on p.codigo = g.codigo and p.layer = m.layer
       and p."row" = cast(floor((m.y0 - g.y) / m.res_y) as int)
       and p."col" = cast(floor((g.x - m.x0) / m.res_x) as int)
  group by g.codigo, g.pid, g.x, g.y)
"""


def grid_features(spark, sf):
    """Grid features, written once to the checkpoint folder: several statistics read them."""
    pts = sampling_grid(spark, sf)
    feat = raster.sample_layers(pts, fx.table(spark, sf, "fx_pixels"),
                                fx.table(spark, sf, "fx_raster_meta"), FX_LAYERS)
    return cut_lineage(feat)


@register("grid_features", fx.oracle(
    _FEATURES_SQL + "select codigo, pid, round(x, 6) as x, round(y, 6) as y, "
    + ", ".join(f"round({l}, 6) as {l}" for l in FX_LAYERS) + " from feat",
    "fx_field_vertices", "fx_raster_meta", "fx_pixels"))
def q_grid_features(spark, sf):
    """Every layer sampled at every grid point, one column per layer."""
    return rounded(grid_features(spark, sf))


_STD_SQL = _FEATURES_SQL + """,
imp as (select codigo, pid, """ + ", ".join(
    f"coalesce({l}, avg({l}) over (partition by codigo)) as {l}" for l in INDEX_LAYERS) + """ from feat)
select codigo, pid, """ + ", ".join(
    f"round(case when stddev_pop({l}) over (partition by codigo) = 0 then {l} - avg({l}) over (partition by codigo) "
    f"else ({l} - avg({l}) over (partition by codigo)) / stddev_pop({l}) over (partition by codigo) end, 6) as {l}"
    for l in INDEX_LAYERS) + " from imp"


@register("impute_standardise", fx.oracle(_STD_SQL, "fx_field_vertices", "fx_raster_meta", "fx_pixels"))
def q_impute_standardise(spark, sf):
    """Mean imputation then standardisation (population std) within each field."""
    g = grid_features(spark, sf).select("codigo", "pid", *INDEX_LAYERS)
    z = stats.standardise(stats.impute_mean(g, INDEX_LAYERS), INDEX_LAYERS)
    return rounded(z.select("codigo", "pid", *INDEX_LAYERS))


_QUOTA_SQL = """
with e as (
  select a.codigo, a.x * b.y - b.x * a.y as t
  from fx_field_vertices a join fx_field_vertices b on a.codigo = b.codigo and b.seq = a.seq + 1),
a as (select codigo, abs(sum(t)) / 2e0 / 1e4 as area_ha from e group by codigo)
select codigo, round(area_ha, 6) as area_ha,
       greatest(cast(round_even(area_ha / 5e-1, 0) as int), 1) as n_puntos
from a
"""


def quotas(spark, sf):
    f = spatial.polygon_area(fields(spark, sf))
    return sampling.sampling_quota(f, HA_PER_POINT)


@register("sampling_quota", fx.oracle(_QUOTA_SQL, "fx_field_vertices"))
def q_sampling_quota(spark, sf):
    """Sampling points per field from its area (half-even rounding)."""
    return rounded(quotas(spark, sf).select("codigo", "area_ha", "n_puntos"))


@register("sampling_design")
def q_sampling_design(spark, sf):
    """K-means on the grid with k = quota, representative point per cluster,
    numbered samples (row-count check: seeds and library K-means cannot match)."""
    grid = sampling_grid(spark, sf)
    q = quotas(spark, sf).select("codigo", F.col("n_puntos").alias("k"))
    assigned, centres = sampling.spatial_kmeans(grid, q)
    reps = sampling.number_samples(sampling.representatives(assigned, centres))
    return rounded(reps.select("codigo", "n", "pid", "x", "y", "cluster"))


# Fixed-centre step: the laboratory sample points act as centres of their field.
_STEP_SQL = _GRID_SQL + """,
c as (select codigo, n - 1 as k, x as cx, y as cy from fx_samples),
d as (select g.codigo, g.pid, g.x, g.y, c.k, c.cx, c.cy,
             sqrt((g.x - c.cx) * (g.x - c.cx) + (g.y - c.cy) * (g.y - c.cy)) as dist from grid g join c on c.codigo = g.codigo),
a as (select * from (select *, row_number() over (partition by codigo, pid order by dist, k) as r from d) where r = 1),
rep as (select * from (select *, row_number() over (partition by codigo, k order by dist, pid) as r2 from a) where r2 = 1),
num as (select codigo, k as cluster, pid, x, y, dist, cast(row_number() over (partition by codigo order by k) as int) as n from rep)
"""


def step_representatives(spark, sf, grid=None):
    grid = sampling_grid(spark, sf) if grid is None else grid
    cs = (fx.table(spark, sf, "fx_samples").groupBy("codigo")
          .agg(F.sort_array(F.collect_list(F.struct("n", "x", "y"))).alias("s"))
          .select("codigo", F.transform("s", lambda t: F.array(t["x"], t["y"])).alias("C")))
    a = sampling.nearest_centre(grid, cs)
    centres = cs.select("codigo", F.posexplode("C").alias("cluster", "c")) \
        .select("codigo", "cluster", F.col("c")[0].alias("cx"), F.col("c")[1].alias("cy"))
    return sampling.number_samples(sampling.representatives(a, centres))


@register("nearest_centre_step", fx.oracle(
    _STEP_SQL + "select codigo, cluster, pid, n, round(x, 6) as x, round(y, 6) as y, round(dist, 6) as dist from num",
    "fx_field_vertices", "fx_samples"))
def q_nearest_centre_step(spark, sf):
    """Nearest centre per grid point, nearest point per centre, numbering."""
    r = step_representatives(spark, sf)
    return rounded(r.select("codigo", "cluster", "pid", "n", "x", "y", "dist"))


_REPR_SQL = _FEATURES_SQL.replace("with b as", "with b as", 1) + _STEP_SQL[len(_GRID_SQL):] + """,
smp as (select f.* from feat f join num on num.codigo = f.codigo and num.pid = f.pid),
lt as (select codigo, idx as "index", v as value from feat
       cross join lateral (values @VALUES) u(idx, v)),
ls as (select codigo, idx as "index", v as value from smp
       cross join lateral (values @VALUES) u(idx, v)),
st as (select codigo, "index", avg(value) as mean_total, stddev_samp(value) as std_total from lt group by codigo, "index"),
ss as (select codigo, "index", avg(value) as mean_sample, stddev_samp(value) as std_sample from ls group by codigo, "index")
""".replace("@VALUES", _VALUES)

_REPR_OUT = """
select st.codigo, st."index", round(mean_total, 6) as mean_total, round(std_total, 6) as std_total,
       round(mean_sample, 6) as mean_sample, round(std_sample, 6) as std_sample,
       round(mean_sample - mean_total, 6) as diff_mean
from st join ss on st.codigo = ss.codigo and st."index" = ss."index"
"""

_DEPS = ("fx_field_vertices", "fx_raster_meta", "fx_pixels", "fx_samples")


def _total_and_sample(spark, sf):
    feat = grid_features(spark, sf)
    reps = step_representatives(spark, sf, feat.select("codigo", "pid", "x", "y")).select("codigo", "pid")
    smp = feat.join(reps, ["codigo", "pid"], "left_semi")
    return feat, smp


@register("representativeness", fx.oracle(_REPR_SQL + _REPR_OUT, *_DEPS))
def q_representativeness(spark, sf):
    """Population vs sample mean and std per index, difference of means."""
    feat, smp = _total_and_sample(spark, sf)
    return rounded(sampling.representativeness(feat, smp, INDEX_LAYERS))


_LONG_SQL = """,
lng as (select codigo, "index", value, 'Total' as Dataset from lt
        union all select codigo, "index", value, 'Muestra' from ls)
"""

_BOX_SQL = _REPR_SQL + _LONG_SQL + """,
q as (select codigo, "index", Dataset, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
             quantile_cont(value, 0.75) as q3, avg(value) as mean
      from lng where value is not null group by codigo, "index", Dataset),
f as (select *, q1 - 1.5e0 * (q3 - q1) as lo_fence, q3 + 1.5e0 * (q3 - q1) as hi_fence from q)
select f.codigo, f."index", f.Dataset, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
       round(mean, 6) as mean,
       round(min(case when l.value between lo_fence and hi_fence then l.value end), 6) as whisker_lo,
       round(max(case when l.value between lo_fence and hi_fence then l.value end), 6) as whisker_hi,
       cast(sum(case when l.value between lo_fence and hi_fence then 0 else 1 end) as bigint) as n_outliers
from f join lng l on l.codigo = f.codigo and l."index" = f."index" and l.Dataset = f.Dataset and l.value is not null
group by f.codigo, f."index", f.Dataset, q1, median, q3, mean
"""


def long_values(spark, sf):
    """Population and sample values in one long table, materialised once (read by several
    aggregation passes)."""
    feat, smp = _total_and_sample(spark, sf)
    return cut_lineage(sampling.tag_and_union(feat, smp, INDEX_LAYERS))


@register("box_summary", fx.oracle(_BOX_SQL, *_DEPS))
def q_box_summary(spark, sf):
    """Box-plot numbers of population and sample per index."""
    return rounded(sampling.box_summary(long_values(spark, sf)))


_HIST_SQL = _REPR_SQL + _LONG_SQL + """,
v as (select * from lng where value is not null),
r as (select codigo, "index", Dataset, min(value) as lo, max(value) as hi, count(*) as nset
      from v group by codigo, "index", Dataset),
p as (select codigo, "index", nset as npop from r where Dataset = 'Total'),
pb as (select r.*, least(50, cast(floor(sqrt(npop)) as int)) as bins, case when lo = hi then 5e-1 else 0e0 end as wide
       from r join p on p.codigo = r.codigo and p."index" = r."index"),
pw as (select codigo, "index", Dataset, nset, bins, lo - wide as lo, (hi + wide - (lo - wide)) / bins as width from pb where bins > 0),
j as (select v.codigo, v."index", v.Dataset, least(cast(floor((v.value - pw.lo) / pw.width) as int), pw.bins - 1) as bin, count(*) as count
      from v join pw on pw.codigo = v.codigo and pw."index" = v."index" and pw.Dataset = v.Dataset
      group by all),
ev as (select pw.*, cast(b as int) as bin from pw, range(0, 50) r(b) where b < bins)
select ev.codigo, ev."index", ev.Dataset, ev.bin, round(lo + ev.bin * width, 6) as "left", coalesce(j.count, 0) as count,
       round(coalesce(j.count, 0) / (nset * width), 6) as density
from ev left join j on j.codigo = ev.codigo and j."index" = ev."index" and j.Dataset = ev.Dataset and j.bin = ev.bin
"""


@register("density_histogram", fx.oracle(_HIST_SQL, *_DEPS))
def q_density_histogram(spark, sf):
    """Density histograms of population and sample on the population's bins."""
    return rounded(sampling.density_histogram(long_values(spark, sf)))


_KDE_SQL = _REPR_SQL + _LONG_SQL + """,
v as (select * from lng where value is not null),
s as (select codigo, "index", Dataset, min(value) as lo, max(value) as hi, count(*) as n, stddev_samp(value) as sd
      from v group by codigo, "index", Dataset),
h as (select *, sd * power(n, -0.2) as h from s where sd * power(n, -0.2) > 0),
ev as (select h.*, t, lo + t * (hi - lo) / 199 as "at" from h, range(0, 200) r(t))
select ev.codigo, ev."index", ev.Dataset, t, round(ev."at", 6) as "at",
       round(sum(exp(-0.5e0 * ((ev."at" - v.value) / ev.h) * ((ev."at" - v.value) / ev.h))) / (ev.n * ev.h * 2.5066282746310002e0), 6) as density
from ev join v on v.codigo = ev.codigo and v."index" = ev."index" and v.Dataset = ev.Dataset
group by ev.codigo, ev."index", ev.Dataset, t, ev."at", ev.n, ev.h
"""


@register("kde_curve", fx.oracle(_KDE_SQL, *_DEPS))
def q_kde_curve(spark, sf):
    """Gaussian kernel density (Scott's bandwidth) of population and sample, 200 points."""
    out = sampling.kde_curve(long_values(spark, sf))
    return rounded(out.withColumn("t", F.col("t").cast("bigint")))
