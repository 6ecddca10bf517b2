"""Dosage template (P21): zone layer + a constant dose column, published in WGS84."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldzones.functions import crs
from fieldzones.functions.numeric import round_even
from fieldzones.operators.zonal import ensure_columns


def dosage_layer(zones: DataFrame, name: str, dose: float = 0.0, src: str = "EPSG:3115",
                 dst: str = "EPSG:4326") -> DataFrame:
    """Zones with ``Zonas``/``Area`` ensured, a dose column rounded to 2 places, in ``dst``.

    The polygon vertices are exploded, transformed as columns and regrouped per polygon
    (zones are a small table; the regrouping is one aggregate).
    """
    name = (name or "").strip()
    if not name:
        raise ValueError("the dose field needs a name")
    z = ensure_columns(zones, ["Zonas", "Area"]).withColumn(name, round_even(F.lit(float(dose)), 2))
    keys = [c for c in z.columns if c not in ("parts", "xmin", "ymin", "xmax", "ymax")]
    v = z.select(*keys, F.posexplode("parts").alias("part", "poly"))
    v = v.select(*keys, "part", F.posexplode("poly").alias("ring", "r"))
    v = v.select(*keys, "part", "ring", F.posexplode("r").alias("seq", "p"))
    v = v.select(*keys, "part", "ring", (F.col("seq") + 1).alias("seq"),
                 F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    v = crs.transform_xy(v, src, dst)
    return v.withColumnsRenamed({"x": "lon", "y": "lat"}) if dst == "EPSG:4326" else v
