"""Checked queries over sources and sinks: lab CSV round trip, chronology CSV, profile."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldzones import fixtures as fx
from fieldzones.operators import chronology as chrono
from fieldzones.plans.registry import register, rounded
from fieldzones.session import run_dir
from fieldzones.sources import io


def _scratch(spark, name: str) -> str:
    """A fresh folder in the shared run folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


_LAB_SQL = """
select codigo, n, round(Arcilla, 6) as Arcilla, round(Arena, 6) as Arena, round(Limo, 6) as Limo,
       round(pH, 6) as pH, round(MO, 6) as MO from fx_soil_lab
"""


@register("lab_csv_roundtrip", fx.oracle(_LAB_SQL, "fx_soil_lab"))
def q_lab_csv_roundtrip(spark, sf):
    """S8 + S1: lab results written as ``;`` CSV per field and read back with the lab schema."""
    path = _scratch(spark, "lab")
    io.write_soil_lab(fx.table(spark, sf, "fx_soil_lab"), path)
    back = io.read_soil_lab(spark, path, partitioned=True)
    return rounded(back.select("codigo", "n", "Arcilla", "Arena", "Limo", "pH", "MO"))


_PROFILE_SQL = """
select 'codigo' as "column", count(codigo) as non_null, 'string' as dtype from fx_soil_lab
union all select 'n', count(n), 'int' from fx_soil_lab
union all select 'Arcilla', count(Arcilla), 'double' from fx_soil_lab
union all select 'Arena', count(Arena), 'double' from fx_soil_lab
union all select 'Limo', count(Limo), 'double' from fx_soil_lab
union all select 'pH', count(pH), 'double' from fx_soil_lab
union all select 'MO', count(MO), 'double' from fx_soil_lab
"""


@register("lab_profile", fx.oracle(_PROFILE_SQL, "fx_soil_lab"))
def q_lab_profile(spark, sf):
    """Non-null count and type of every lab column."""
    return io.profile(fx.table(spark, sf, "fx_soil_lab"))


# Spreadsheet-style headings of the chronology (with stray blanks).
HEADINGS = {"cod_hacienda": " Cod. Hacienda", "nombre_hacienda": "Nombre Hacienda ",
            "cod_suerte": "Cod. Suerte", "edad": "Edad", "variedad": "Variedad",
            "numero_cortes": "Numero de Cortes", "fecha_liquidacion": "Fecha Liquidacion",
            "tchc": "TCHC", "area_total": "Area Total"}

_CSV_VIEW_SQL = """
select case when cod_hacienda = 'nan' then '' else cod_hacienda end as "Cod.",
       nombre_hacienda as Hacienda, cod_suerte as Ste, cast(edad as varchar) as Edad, variedad as Variedad,
       cast(numero_cortes as varchar) as NC, cast(fecha_liquidacion as varchar) as "Fecha Liquidacion",
       case when regexp_matches(tchc, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$')
            then round(round_even(cast(trim(tchc) as double), 2), 6) end as TCHC,
       cast(area_total as varchar) as Area
from fx_chronology
"""


@register("chronology_csv", fx.oracle(_CSV_VIEW_SQL, "fx_chronology"))
def q_chronology_csv(spark, sf):
    """Chronology written with spreadsheet headings, read back as text,
    headings stripped and resolved by tokens, displayed."""
    path = _scratch(spark, "chrono")
    src = fx.table(spark, sf, "fx_chronology")
    src.select(*[F.col(c).alias(h) for c, h in HEADINGS.items()]) \
        .write.mode("overwrite").option("header", True).csv(path)
    df = chrono.with_codigo(io.read_chronology(spark, path))
    return rounded(chrono.harvest_view(df))
