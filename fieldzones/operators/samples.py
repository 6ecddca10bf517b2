"""Sample layers and laboratory results.

All sources are read in one scan (the file path travels as a column), so unifying a
thousand sample layers is one job, not a loop of reads and concatenations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldzones.functions.numeric import to_number
from fieldzones.functions.text import file_name
from fieldzones.session import join_small

# Standard names of the index and production layers.
STANDARD_LAYER_NAMES = {
    "EVI_Hist_1": "EVI_Hist1", "EVI_Hist_2": "EVI_Hist2", "EVI_Hist_3": "EVI_Hist3",
    "EVI_Hist_4": "EVI_Hist4", "EVI_Hist_5": "EVI_Hist5",
    "NDVI_Pl_1": "NDVI_Pl_1", "NDVI_Pl_2": "NDVI_Pl_2", "NDVI_Pl_3": "NDVI_Pl_3",
    "NDVI_Pl_4": "NDVI_Pl_4", "NDVI_Pl_5": "NDVI_Pl_5",
    "PROD_21": "PROD21", "PROD_22": "PROD22", "PROD_23": "PROD23",
    "PROD_PRO": "PRODPRO", "PROD_CV": "PRODCV",
}
# Prefixes of predictor columns.
PREDICTOR_PREFIXES = ("EVI", "NDVI", "PROD")
# Soil variables modelled and kriged, in this order.
SOIL_VARIABLES = ["Arcilla", "Limo", "Arena", "pH", "MO", "P", "K", "Na", "Ca", "Mg", "CIC",
                  "S", "Fe", "Mn", "Zn", "Cu", "B"]


def standardise_layers(df: DataFrame) -> DataFrame:
    """Rename layer columns to their standard names (unknown names pass through)."""
    present = {k: v for k, v in STANDARD_LAYER_NAMES.items() if k in df.columns and k != v}
    return df.withColumnsRenamed(present) if present else df


def predictor_columns(columns: list[str]) -> list[str]:
    """Columns whose name starts with EVI, NDVI or PROD, in table order."""
    return [c for c in columns if c.startswith(PREDICTOR_PREFIXES)]


def pca_inputs(layers: list[str], k: int = 10) -> list[str]:
    """The first ``k`` layers, taken in name order (file listing order is arbitrary)."""
    return sorted(layers)[:k]


def present(columns: list[str], wanted: list[str]) -> tuple[list[str], list[str]]:
    """P20: (variables present, variables skipped)."""
    have = [v for v in wanted if v in columns]
    return have, [v for v in wanted if v not in columns]


def complete_cases(df: DataFrame, cols) -> DataFrame:
    """Rows with no null in ``cols`` (``dropna``)."""
    return df.na.drop(subset=list(cols))


def coerce_numeric(df: DataFrame, cols) -> DataFrame:
    """P5 over columns: text that is not a number becomes null; numbers stay as they are."""
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "varchar", "char")}
    return df.withColumns({c: to_number(F.col(c)) if c in text else F.col(c).cast("double") for c in cols})


def join_lab(samples: DataFrame, lab: DataFrame) -> DataFrame:
    """Samples with their laboratory results on (codigo, n); a null ``n`` never matches."""
    lab = lab.filter(F.col("n").isNotNull())
    return join_small(samples.filter(F.col("n").isNotNull()), lab, ["codigo", "n"], "inner")


def source_code(path) -> F.Column:
    """code = file name without ``Muestras``, up to the first ``_``."""
    return F.element_at(F.split(F.replace(file_name(path), F.lit("Muestras"), F.lit("")), "_"), 1)


def label_samples(points: DataFrame, path_col: str = "path") -> DataFrame:
    """``Muestra = 'M' || n`` and ``name = Muestra || '_' || code``."""
    muestra = F.concat(F.lit("M"), F.col("n").cast("string"))
    return (points.withColumn("Muestra", muestra)
            .withColumn("name", F.concat(F.col("Muestra"), F.lit("_"), source_code(F.col(path_col)))))


def validate_sources(points: DataFrame, selected: DataFrame, path_col: str = "path") -> None:
    """All or nothing - every selected source must exist and carry a column ``n``."""
    if "n" not in points.columns:
        raise ValueError("sample layers have no column 'n'")
    missing = selected.join(points.select(path_col).distinct(), path_col, "left_anti")
    if missing.limit(1).count() > 0:
        first = missing.first()[0]
        raise FileNotFoundError(f"sample layer not found: {first}")


def add_sources(selected: DataFrame, new: DataFrame) -> DataFrame:
    """Append new paths, keeping the first occurrence and the selection order.

    Inputs carry ``path, pos``; the result is ordered by ``(batch, pos)``: batch 0 for the
    existing selection, 1 for the added paths.
    """
    both = (selected.select("path", F.lit(0).alias("batch"), F.col("pos").cast("long"))
            .unionByName(new.select("path", F.lit(1).alias("batch"), F.col("pos").cast("long"))))
    first = both.groupBy("path").agg(F.min(F.struct("batch", "pos")).alias("o"))
    return first.select("path", "o.batch", "o.pos")


def exclude_sources(selected: DataFrame, removed: DataFrame) -> DataFrame:
    """Remove sources from a selection (anti-join on the path)."""
    return selected.join(removed.select("path").distinct(), "path", "left_anti")


def unify_samples(points: DataFrame, selected: DataFrame | None = None,
                  path_col: str = "path") -> DataFrame:
    """All selected sample layers as one point layer ``n, Muestra, name, x, y``."""
    if selected is not None:
        validate_sources(points, selected, path_col)
        points = join_small(points, selected.select(path_col).distinct(), path_col, "left_semi")
    out = label_samples(points, path_col)
    return out.select("n", "Muestra", "name", "x", "y", path_col)


def count_points(unified: DataFrame, path_col: str = "path") -> DataFrame:
    """Points per source (and the total with ``groupBy().count()``)."""
    return unified.groupBy(path_col).agg(F.count(F.lit(1)).alias("n_points"))
