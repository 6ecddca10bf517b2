"""Readers, writers and file discovery.

Files are found with Spark's own listing (``binaryFile`` with only ``path`` selected, so
no content is read) and every table format is a plain Spark source.  Writers partition by
``codigo`` (and ``layer`` for rasters), so a later read of one field or one layer prunes
partitions.  Single-file desktop formats (GeoTIFF, shapefile, Excel, GPX) are not read:
inputs arrive as parquet or CSV tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from fieldzones.functions.text import file_name, zone_code
from fieldzones.operators.chronology import strip_headings
from fieldzones.operators.zonal import mask_nodata

# Columns of the laboratory CSV, in file order.
LAB_COLUMNS = ["Lab", "Lote", "n", "cm", "Arena", "Arcilla", "Limo", "Textural", "pH", "MO", "P",
               "K", "Na", "Ca", "Mg", "CIC", "S", "Fe", "Mn", "Cu", "Zn", "B"]
_TEXT = {"Lab", "Lote", "cm", "Textural"}

LAB_SCHEMA = StructType([
    StructField(c, StringType() if c in _TEXT else IntegerType() if c == "n" else DoubleType())
    for c in LAB_COLUMNS])


def read_soil_lab(spark: SparkSession, path: str, codigo: str | None = None,
                  partitioned: bool = False) -> DataFrame:
    """``;``-separated lab CSV with ``.`` decimals; blanks after separators skipped.

    ``partitioned``: a folder written by :func:`write_soil_lab` (``codigo=...`` sub-folders).
    """
    schema = LAB_SCHEMA
    if partitioned:
        schema = StructType(LAB_SCHEMA.fields + [StructField("codigo", StringType())])
    df = (spark.read.option("sep", ";").option("header", True)
          .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
          .schema(schema).csv(path))
    return df.withColumn("codigo", F.lit(codigo)) if codigo is not None else df


def write_soil_lab(df: DataFrame, path: str) -> None:
    """The lab CSV layout (``;``, all lab columns in file order), one folder per field."""
    cols = [F.col(c) if c in df.columns else F.lit(None).cast(LAB_SCHEMA[c].dataType).alias(c)
            for c in LAB_COLUMNS]
    (df.select(*cols, "codigo").write.mode("overwrite").option("sep", ";").option("header", True)
     .partitionBy("codigo").csv(path))


def read_features(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Comma CSV feature table (header, numbers inferred only when no schema is given)."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet layer (vertices, points, pixels) - partition pruning on codigo/layer."""
    return spark.read.parquet(path)


def read_chronology(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Harvest chronology with stripped headings; a missing path raises."""
    if fmt == "csv":
        df = spark.read.option("header", True).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    return strip_headings(df)


def read_raster(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pixels and metadata written by :func:`write_pixels`; declared nodata is null."""
    meta = spark.read.parquet(f"{path}/meta")
    return mask_nodata(spark.read.parquet(f"{path}/pixels"), meta, undeclared=False), meta


def list_files(spark: SparkSession, base: str, glob: str = "*") -> DataFrame:
    """File catalogue under ``base`` (recursive): only the ``path`` column is read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(base).select("path"))


def discover_samples(spark: SparkSession, base: str) -> DataFrame:
    """Sample layers ``<estate>/<field>/SHP/Muestras*.shp`` (prefix case-sensitive,
    extension case-insensitive), with estate and field, sorted."""
    files = list_files(spark, base)
    name = file_name(F.col("path"))
    parts = F.split(F.col("path"), "/")
    hits = files.filter(name.startswith("Muestras") & F.lower(name).endswith(".shp")
                        & (F.element_at(parts, -2) == "SHP"))
    return (hits.select(F.element_at(parts, -4).alias("hacienda"), F.element_at(parts, -3).alias("suerte"),
                        "path").orderBy("hacienda", "suerte", "path"))


def discover_files(spark: SparkSession, base: str, pattern: str, key=None) -> DataFrame:
    """Files whose name matches the regex ``pattern``; with ``key`` (a column
    expression over ``path``) only the first path per key in sorted order."""
    files = list_files(spark, base).filter(file_name(F.col("path")).rlike(pattern))
    if key is None:
        return files.orderBy("path")
    w = Window.partitionBy("_k").orderBy("path")
    return (files.withColumn("_k", key).withColumn("_r", F.row_number().over(w))
            .filter(F.col("_r") == 1).drop("_r").withColumnRenamed("_k", "key"))


def zone_files(spark: SparkSession, base: str) -> DataFrame:
    """P25 + S7: zone files ``ZM_<code>.tif|.shp`` and the field code of each, first per code."""
    return discover_files(spark, base, r"^ZM_.*\.(tif|shp)$", key=zone_code(F.col("path"))) \
        .withColumnRenamed("key", "codigo")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one folder per field."""
    df.write.mode("overwrite").option("header", True).partitionBy("codigo").csv(path)


def write_layer(df: DataFrame, path: str) -> None:
    """A point or polygon layer (or report) as parquet partitioned by field."""
    df.write.mode("overwrite").partitionBy("codigo").parquet(path)


def write_pixels(pixels: DataFrame, meta: DataFrame, path: str, nodata: float | None = None) -> None:
    """Raster pixels partitioned by field and layer, metadata next to them; a sentinel for
    missing values is declared in the metadata, so that readers mask it again."""
    if nodata is not None:
        pixels = pixels.withColumn("value", F.coalesce(F.col("value"), F.lit(float(nodata))))
        meta = meta.withColumn("nodata", F.lit(float(nodata)))
    pixels.write.mode("overwrite").partitionBy("codigo", "layer").parquet(f"{path}/pixels")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def profile(df: DataFrame) -> DataFrame:
    """Non-null count and type of every column (one aggregate, unpivoted)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    types = dict(df.dtypes)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("non_null"),
                              F.lit(types[c]).alias("dtype")) for c in df.columns])
    return counts.select(F.explode(rows).alias("r")).select("r.*")
