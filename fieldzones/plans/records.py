"""Checked queries: harvest chronology lookup, sample unification, laboratory join."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldzones import fixtures as fx
from fieldzones.functions import crs
from fieldzones.operators import chronology as chrono
from fieldzones.operators import samples as smp
from fieldzones.plans.registry import register, rounded

# ---------------------------------------------------------------- chronology


def chronology(spark, sf):
    return chrono.with_codigo(chrono.strip_headings(fx.table(spark, sf, "fx_chronology")))


_CODIGO_SQL = """
with t as (
  select cod_hacienda, cod_suerte,
         case when cod_hacienda = 'nan' then '' else cod_hacienda end as h,
         case when cod_suerte = 'nan' then '' else cod_suerte end as s
  from fx_chronology)
select cod_hacienda, cod_suerte,
       lpad(h, cast(greatest(length(h), 3) as int), '0') || lpad(s, cast(greatest(length(s), 4) as int), '0') as CODIGO
from t
"""


@register("chronology_codigo", fx.oracle(_CODIGO_SQL, "fx_chronology"))
def q_chronology_codigo(spark, sf):
    """Field code built from the resolved estate and field headings."""
    return chronology(spark, sf).select("cod_hacienda", "cod_suerte", "CODIGO")


def _view_sql(where: str) -> str:
    # Resolution of the fixture headings, worked out by hand from the token rules:
    # Cod. -> CODIGO (2 tokens), Hacienda -> nombre_hacienda, Ste -> cod_suerte,
    # NC -> none, Area -> cod_hacienda (first column containing 'ha').
    return f"""
with t as (
  select *,
         case when cod_hacienda = 'nan' then '' else cod_hacienda end as h,
         case when cod_suerte = 'nan' then '' else cod_suerte end as s
  from fx_chronology),
c as (select *, lpad(h, cast(greatest(length(h), 3) as int), '0') || lpad(s, cast(greatest(length(s), 4) as int), '0') as CODIGO from t)
select CODIGO as "Cod.", nombre_hacienda as Hacienda, cod_suerte as Ste,
       cast(edad as varchar) as Edad, variedad as Variedad, '' as NC,
       cast(fecha_liquidacion as varchar) as "Fecha Liquidacion",
       case when regexp_matches(tchc, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$')
            then round(round_even(cast(trim(tchc) as double), 2), 6) end as TCHC,
       case when cod_hacienda = 'nan' then '' else cod_hacienda end as Area
from c {where}
"""


@register("harvest_view", fx.oracle(_view_sql(""), "fx_chronology"))
def q_harvest_view(spark, sf):
    """Display projection of the whole chronology."""
    return rounded(chrono.harvest_view(chronology(spark, sf)))


@register("harvest_lookup", fx.oracle(
    _view_sql("where CODIGO in (select codigo from fx_fields)"), "fx_chronology", "fx_fields"))
def q_harvest_lookup(spark, sf):
    """P16 (many codes, semi-join) + P17: harvest records of the fields in the field table."""
    codes = fx.table(spark, sf, "fx_fields").select("codigo")
    return rounded(chrono.harvest_view(chrono.find_by_codes(chronology(spark, sf), codes)))


# ---------------------------------------------------------------- sample layers

_PATH = ("'/campo/HDA' || substr(codigo, 1, 3) || '/' || codigo || '/SHP/Muestras' || codigo || '_2024.shp'")


def sample_sources(spark, sf):
    """Sample points of every field, tagged with the layer file they would come from."""
    s = fx.table(spark, sf, "fx_samples")
    return s.select("codigo", "n", "x", "y", F.expr(_PATH).alias("path"))


_CRS = "case when n % 3 = 1 then 'EPSG:3115' when n % 3 = 2 then 'EPSG:3116' end"


def _unify_sql():
    base = f"select n, x, y, {_PATH} as path from fx_samples where n % 3"
    moved = crs.sql_steps(f"{base} = 1", ["n", "x", "y", "path"], crs.transform_steps("EPSG:3115", "EPSG:3116"))
    return f"""
select n, 'M' || cast(n as varchar) as Muestra,
       'M' || cast(n as varchar) || '_' || split_part(replace(path, '/campo/HDA', ''), '/', 2) as name,
       round(x, 3) as x, round(y, 3) as y, path
from ({moved} union all {base} <> 1) m
"""


@register("unify_samples", fx.oracle(_unify_sql(), "fx_samples"))
def q_unify_samples(spark, sf):
    """Sample layers of several systems as one in EPSG:3116; where the system
    is missing it is EPSG:3116 already."""
    pts = crs.to_crs(sample_sources(spark, sf).withColumn("crs", F.expr(_CRS)), "EPSG:3116", default_src="EPSG:3116")
    out = smp.unify_samples(pts)
    return out.select("n", "Muestra", "name", F.round("x", 3).alias("x"),
                      F.round("y", 3).alias("y"), "path")


_COUNT_SQL = f"select path, count(*) as n_points from (select {_PATH} as path from fx_samples) t group by path"


@register("count_points", fx.oracle(_COUNT_SQL, "fx_samples"))
def q_count_points(spark, sf):
    """Points per unified source."""
    return smp.count_points(smp.unify_samples(sample_sources(spark, sf)))


_SELECT_SQL = f"""
with src as (select distinct {_PATH} as path, codigo from fx_samples)
select path, case when cast(substr(codigo, 7, 1) as int) % 2 = 0 then 0 else 1 end as batch,
       cast(codigo as bigint) as pos
from src where substr(codigo, 7, 1) <> '3'
"""


@register("source_selection", fx.oracle(_SELECT_SQL, "fx_samples"))
def q_source_selection(spark, sf):
    """U2 + J10: select the even fields, add all fields (no duplicates, order kept), then
    remove the fields whose code ends in 3."""
    src = (sample_sources(spark, sf).select("path", "codigo").distinct()
           .withColumn("pos", F.col("codigo").cast("long")))
    even = src.filter((F.substring("codigo", 7, 1).cast("int") % 2) == 0)
    sel = smp.add_sources(even, src)
    removed = src.filter(F.substring("codigo", 7, 1) == "3")
    return smp.exclude_sources(sel, removed).select("path", "batch", "pos")


_LAB_SQL = """
select m.codigo, m.n, round(m.x, 6) as x, round(m.y, 6) as y,
       round(l.Arcilla, 6) as Arcilla, round(l.Arena, 6) as Arena, round(l.Limo, 6) as Limo,
       round(l.pH, 6) as pH, round(l.MO, 6) as MO
from fx_samples m join fx_soil_lab l on l.codigo = m.codigo and l.n = m.n
"""


@register("join_lab", fx.oracle(_LAB_SQL, "fx_samples", "fx_soil_lab"))
def q_join_lab(spark, sf):
    """Sample points with their laboratory results on (codigo, n)."""
    s = fx.table(spark, sf, "fx_samples").select("codigo", "n", "x", "y")
    lab = fx.table(spark, sf, "fx_soil_lab")
    return rounded(smp.join_lab(s, lab).select("codigo", "n", "x", "y", "Arcilla", "Arena",
                                               "Limo", "pH", "MO"))


_SOIL = ["Arcilla", "Arena", "Limo", "pH", "MO"]
_COMPLETE_SQL = f"""
select codigo, n, {", ".join(f"round({c}, 6) as {c}" for c in _SOIL)} from fx_soil_lab
where {" and ".join(f"{c} is not null" for c in _SOIL)}
"""


@register("complete_cases", fx.oracle(_COMPLETE_SQL, "fx_soil_lab"))
def q_complete_cases(spark, sf):
    """Complete-case filter over all soil columns of the laboratory table."""
    lab = fx.table(spark, sf, "fx_soil_lab")
    return rounded(smp.complete_cases(lab, _SOIL).select("codigo", "n", *_SOIL))
