"""Registry of the checked queries: a Spark callable and its DuckDB oracle text per name.

Each Spark callable takes ``(spark, sf_dir)``, derives its inputs from the driver tables
with the shared fixture SQL, runs the library operator and returns a DataFrame.  The
oracle computes the same result independently in DuckDB SQL.  Doubles are rounded to
6 places after the last aggregate on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (the last step of a checked query)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.round(c.cast("double"), digits).alias(f.name)
        cols.append(c)
    return df.select(*cols)
