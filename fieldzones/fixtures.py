"""Derived test tables: one SQL text per table, run by Spark and by the DuckDB oracle.

The driver tables (``nation``, ``part``, ``supplier``, ...) stand in for the field, raster,
laboratory and chronology inputs; the recipes are documented in FIXTURES.md.  Two dialect
differences are handled by substitution: the quoting of the ``row``/``col`` identifiers and
1-based array access.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldzones.session import parallelism, stored_bytes

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

_SQL = {
    "fx_fields": """
select lpad(cast(n_regionkey as string), 3, '0') || lpad(cast(n_nationkey as string), 4, '0') as codigo,
       n_nationkey as k,
       1.06e6 + 7e2 * (n_nationkey % 5) as ox,
       8.6e5 + 6e3 * cast(floor(n_nationkey / 5) as int) as oy,
       1e1 * (select max(cast(floor(p_partkey / 40) as int)) + 1 from part) as h
from nation""",
    "fx_field_vertices": """
select codigo, 1 as part, 0 as ring, seq, x, y from (
  select codigo, 1 as seq, ox + 3e0 as x, oy + 3e0 as y from fx_fields
  union all select codigo, 2, ox + 3.9725e2 - k, oy + 3e0 from fx_fields
  union all select codigo, 3, ox + 3.9725e2 - k, oy + 6e-1 * h + 1.5e0 from fx_fields
  union all select codigo, 4, ox + 2.035e2, oy + 6e-1 * h + 1.5e0 from fx_fields
  union all select codigo, 5, ox + 2.035e2, oy + h - 2.5e0 from fx_fields
  union all select codigo, 6, ox + 3e0, oy + h - 2.5e0 from fx_fields
  union all select codigo, 7, ox + 3e0, oy + 3e0 from fx_fields) v""",
    "fx_zones": """
select codigo, z as Zonas, ox as x1, ox + 4e2 as x2,
       oy + h * (z - 1) / 3e0 + 3e-1 as y1, oy + h * z / 3e0 + 3e-1 as y2
from fx_fields cross join (select 1 as z union all select 2 union all select 3) t""",
    # zone rectangles as closed counter-clockwise vertex rings (one row per vertex)
    "fx_zone_vertices": """
select codigo, Zonas, 1 as part, 0 as ring, seq, x, y from (
  select codigo, Zonas, 1 as seq, x1 as x, y1 as y from fx_zones
  union all select codigo, Zonas, 2, x2, y1 from fx_zones
  union all select codigo, Zonas, 3, x2, y2 from fx_zones
  union all select codigo, Zonas, 4, x1, y2 from fx_zones
  union all select codigo, Zonas, 5, x1, y1 from fx_zones) v""",
    "fx_pixels": """
select f.codigo, l.layer, cast(floor(p.p_partkey / 40) as int) as {row}, cast(p.p_partkey % 40 as int) as {col},
       f.ox + 1e1 * (p.p_partkey % 40) + 5e0 as x,
       f.oy + f.h - 1e1 * cast(floor(p.p_partkey / 40) as int) - 5e0 as y,
       case when p.p_partkey % 97 = 0 then null
            else l.a + l.b * sin(floor(p.p_partkey / 40) / 7e0 + f.k) + l.c * cos((p.p_partkey % 40) / 9e0) + p.p_size * l.d end as value
from part p cross join fx_fields f cross join (
  select 'NDVI_Pl_1' as layer, 5e-1 as a, 2e-1 as b, 1e-1 as c, 1e-3 as d
  union all select 'EVI_Hist_1', 4e-1, 1e-1, 2e-1, 1e-3
  union all select 'PROD_1', 1.1e2, 2e1, 1e1, 1e-1
  union all select 'Arcilla', 3e1, 5e0, 3e0, 5e-2
  union all select 'Arena', 4e1, -4e0, 2e0, 5e-2
  union all select 'Limo', 3e1, -1e0, -5e0, 5e-2
  union all select 'pH', 6.5e0, 3e-1, 2e-1, 1e-3) l""",
    # raster metadata of fx_pixels: top-left origin, 10 m cells, 40 columns
    "fx_raster_meta": """
select f.codigo, l.layer, f.ox as x0, f.oy + f.h as y0, 1e1 as res_x, 1e1 as res_y,
       cast(f.h / 1e1 as int) as n_rows, 40 as n_cols
from fx_fields f cross join (
  select 'NDVI_Pl_1' as layer union all select 'EVI_Hist_1' union all select 'PROD_1'
  union all select 'Arcilla' union all select 'Arena' union all select 'Limo' union all select 'pH') l""",
    # fields of several parts: a rectangle (with a hole where k % 3 = 0) and a second one, which
    # crosses itself where k % 5 = 4
    "fx_parcel_vertices": """
select codigo, part, ring, seq, x, y from (
  select codigo, k, 1 as part, 0 as ring, 1 as seq, ox + 0e0 as x, oy + 0e0 as y from fx_fields
  union all select codigo, k, 1 as part, 0 as ring, 2 as seq, ox + (1e2 + 1e1 * k) as x, oy + 0e0 as y from fx_fields
  union all select codigo, k, 1 as part, 0 as ring, 3 as seq, ox + (1e2 + 1e1 * k) as x, oy + 1.2e2 as y from fx_fields
  union all select codigo, k, 1 as part, 0 as ring, 4 as seq, ox + 0e0 as x, oy + 1.2e2 as y from fx_fields
  union all select codigo, k, 1 as part, 0 as ring, 5 as seq, ox + 0e0 as x, oy + 0e0 as y from fx_fields
  union all select codigo, k, 1 as part, 1 as ring, 1 as seq, ox + 2e1 as x, oy + 2e1 as y from fx_fields where k % 3 = 0
  union all select codigo, k, 1 as part, 1 as ring, 2 as seq, ox + 4e1 as x, oy + 2e1 as y from fx_fields where k % 3 = 0
  union all select codigo, k, 1 as part, 1 as ring, 3 as seq, ox + 4e1 as x, oy + 4e1 as y from fx_fields where k % 3 = 0
  union all select codigo, k, 1 as part, 1 as ring, 4 as seq, ox + 2e1 as x, oy + 4e1 as y from fx_fields where k % 3 = 0
  union all select codigo, k, 1 as part, 1 as ring, 5 as seq, ox + 2e1 as x, oy + 2e1 as y from fx_fields where k % 3 = 0
  union all select codigo, k, 2 as part, 0 as ring, 1 as seq, ox + 5e2 as x, oy + 0e0 as y from fx_fields where k % 5 <> 4
  union all select codigo, k, 2 as part, 0 as ring, 2 as seq, ox + 6e2 as x, oy + 0e0 as y from fx_fields where k % 5 <> 4
  union all select codigo, k, 2 as part, 0 as ring, 3 as seq, ox + 6e2 as x, oy + (6e1 + 5e0 * k) as y from fx_fields where k % 5 <> 4
  union all select codigo, k, 2 as part, 0 as ring, 4 as seq, ox + 5e2 as x, oy + (6e1 + 5e0 * k) as y from fx_fields where k % 5 <> 4
  union all select codigo, k, 2 as part, 0 as ring, 5 as seq, ox + 5e2 as x, oy + 0e0 as y from fx_fields where k % 5 <> 4
  union all select codigo, k, 2, 0, 1, ox + 5e2, oy + 0e0 from fx_fields where k % 5 = 4
  union all select codigo, k, 2, 0, 2, ox + 6e2, oy + 8e1 from fx_fields where k % 5 = 4
  union all select codigo, k, 2, 0, 3, ox + 6e2, oy + 0e0 from fx_fields where k % 5 = 4
  union all select codigo, k, 2, 0, 4, ox + 5e2, oy + 4e1 from fx_fields where k % 5 = 4
  union all select codigo, k, 2, 0, 5, ox + 5e2, oy + 0e0 from fx_fields where k % 5 = 4) v""",
    # input rasters of the layer plan, some of them missing
    "fx_input_meta": """
select f.codigo, p.pre || '_' || f.codigo || '_' || cast(n.i as string) as layer
from fx_fields f
cross join (select 'NDVI_median' as pre union all select 'EVI_median' union all select 'PROD_median') p
cross join (select 1 as i union all select 2 union all select 3 union all select 4 union all select 5) n
where (f.k + n.i) % 4 <> 0""",
    "fx_samples": """
select f.codigo, cast(row_number() over (partition by f.codigo order by s.s_suppkey) as int) as n,
       f.ox + 2e1 + (s.s_suppkey * 37) % 160 as x, f.oy + 2e1 + (s.s_suppkey * 53) % 25 as y, s.s_suppkey
from supplier s join fx_fields f on f.k = s.s_nationkey""",
    "fx_soil_lab": """
select m.codigo, m.n, 2e1 + s.s_acctbal / 1e3 as Arcilla, 6e1 - s.s_acctbal / 5e2 as Arena,
       2e1 + s.s_acctbal / 1e3 as Limo, 5e0 + s.s_acctbal / 4e3 as pH,
       case when s.s_suppkey % 7 = 0 then null else 2e0 + s.s_acctbal / 5e3 end as MO
from fx_samples m join supplier s on s.s_suppkey = m.s_suppkey
where m.s_suppkey % 11 <> 0""",
    "fx_chronology": """
select case when o.o_orderkey % 41 = 0 then 'nan' else cast(c.c_nationkey as string) end as cod_hacienda,
       'HDA ' || cast(c.c_nationkey as string) as nombre_hacienda,
       cast(o.o_custkey % 60 as string) as cod_suerte,
       11 + o.o_orderkey % 4 as edad, o.o_orderpriority as variedad, o.o_orderkey % 9 as numero_cortes,
       cast(o.o_orderdate as date) as fecha_liquidacion,
       case when o.o_orderkey % 11 = 0 then 'nan' when o.o_orderkey % 13 = 0 then '5d'
            else cast(cast(floor(o.o_totalprice / 1e3) as int) as string) || '.' || cast(o.o_orderkey % 10 as string) || '25' end as tchc,
       2e0 + (o.o_orderkey % 30) / 4e0 as area_total
from orders o join customer c on c.c_custkey = o.o_custkey""",
    "fx_multivar": """
select lpad(cast(label as string), 7, '0') as codigo, vec_id as pid,
       1e1 * (vec_id % 25) as x, 1e1 * cast(floor(vec_id / 25) as int) as y,
       cast({1} as double) as Arcilla, cast({2} as double) as Limo, cast({3} as double) as Arena, cast({4} as double) as pH,
       cast({5} as double) as MO, cast({6} as double) as Na, cast({7} as double) as Ca, cast({8} as double) as CIC
from embeddings""",
}

DEPENDS = {
    "fx_fields": ("nation", "part"),
    "fx_field_vertices": ("fx_fields",),
    "fx_zones": ("fx_fields",),
    "fx_zone_vertices": ("fx_zones",),
    "fx_pixels": ("part", "fx_fields"),
    "fx_raster_meta": ("fx_fields",),
    "fx_parcel_vertices": ("fx_fields",),
    "fx_input_meta": ("fx_fields",),
    "fx_samples": ("supplier", "fx_fields"),
    "fx_soil_lab": ("fx_samples", "supplier"),
    "fx_chronology": ("orders", "customer"),
    "fx_multivar": ("embeddings",),
}


# Base tables whose rows the recipes multiply into large fixtures.
GENERATORS = {"part", "orders", "customer", "supplier", "embeddings"}

# Bytes of a base file whose derived rows one task makes.
GENERATOR_BYTES = 256 << 10

# Fixtures with one row per field, zone, vertex or sample: cached once derived.
SMALL = {"fx_fields", "fx_field_vertices", "fx_zones", "fx_zone_vertices", "fx_raster_meta",
         "fx_samples", "fx_soil_lab"}


def sql_text(name: str, dialect: str) -> str:
    """The recipe of ``name`` in ``dialect`` ('spark' or 'duckdb')."""
    text = _SQL[name]
    if dialect == "spark":
        text = text.replace("{row}", "`row`").replace("{col}", "`col`")
        for i in range(1, 9):
            text = text.replace("{%d}" % i, "element_at(embedding, %d)" % i)
    else:
        text = text.replace("{row}", '"row"').replace("{col}", '"col"')
        for i in range(1, 9):
            text = text.replace("{%d}" % i, "embedding[%d]" % i)
    return text


def _closure(names) -> list[str]:
    """Fixture names in dependency order (base tables excluded)."""
    out: list[str] = []

    def visit(n):
        if n in BASE_TABLES or n in out:
            return
        for d in DEPENDS[n]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register the base tables and the requested fixtures as temp views."""
    needed = _closure(names)
    bases = set()
    for n in list(names) + needed:
        for d in DEPENDS.get(n, (n,) if n in BASE_TABLES else ()):
            if d in BASE_TABLES:
                bases.add(d)
    for b in sorted(bases):
        df = spark.read.parquet(f"{sf_dir}/{b}.parquet")
        if b in GENERATORS:
            # a small file that is multiplied by the recipes (part -> pixels, orders ->
            # chronology): spread it over all cores so the derived rows are made in parallel, and
            # into bounded tasks where it is large
            df = df.repartition(max(parallelism(spark), -(-stored_bytes(df) // GENERATOR_BYTES)))
        df.createOrReplaceTempView(b)
    for n in needed:
        df = spark.sql(sql_text(n, "spark"))
        if n in SMALL:
            df = df.cache()  # derived once per session, reused by every query
        df.createOrReplaceTempView(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture (or base table) as a DataFrame."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    register(spark, sf_dir, name)
    return spark.table(name)


def oracle(body: str, *names: str) -> str:
    """DuckDB text: the fixtures as a WITH list in front of ``body``."""
    needed = _closure(names)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} as ({sql_text(n, 'duckdb')})" for n in needed)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
