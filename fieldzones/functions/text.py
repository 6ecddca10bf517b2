"""Text rules (F1-F7, P2, P25) as JVM-side column expressions.

They reproduce Python/pandas string behaviour that differs from the SQL built-ins:
``str.strip`` removes every kind of whitespace, ``zfill`` pads but never truncates and keeps
a leading sign first, and ``replace('nan', '')`` on a Series replaces whole values only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: leading/trailing spaces, tabs and newlines."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def as_text(c) -> Column:
    """``astype(str)``; null becomes the text ``nan`` as pandas prints a missing float."""
    return F.coalesce(_c(c).cast("string"), F.lit("nan"))


def blank_nan(c) -> Column:
    """Whole-value replacement ``'nan' -> ''`` (not a substring replace)."""
    c = _c(c)
    return F.when(c == F.lit("nan"), F.lit("")).otherwise(c)


def zfill(c, width: int) -> Column:
    """Python ``str.zfill``: pad with zeros after an optional sign, never truncate."""
    c = _c(c)
    signed = c.startswith("-") | c.startswith("+")
    body = F.when(signed, F.substring(c, 2, 1 << 30)).otherwise(c)
    sign = F.when(signed, F.substring(c, 1, 1)).otherwise(F.lit(""))
    pad_to = F.greatest(F.length(c), F.lit(width)) - F.length(sign)
    return F.concat(sign, F.lpad(body, pad_to, "0"))


def file_name(path) -> Column:
    """Base name of a path (``os.path.basename``)."""
    return F.element_at(F.split(_c(path), "/"), -1)


def file_stem(path) -> Column:
    """Base name without its last extension (``os.path.splitext``)."""
    return F.regexp_replace(file_name(path), r"\.[^./]*$", "")


def layer_name(path) -> Column:
    """Raster layer name = base name without ``.tif``, first 10 characters."""
    return F.substring(F.replace(file_name(path), F.lit(".tif"), F.lit("")), 1, 10)


def zone_code(path) -> Column:
    """P25: field code from a zone file name: all text after ``ZM_``, extension removed."""
    return F.regexp_extract(file_name(path), r"^ZM_(.*)\.[^.]+$", 1)


def report_code(path) -> Column:
    """P25 (report variant): only the second ``_`` token of the stem."""
    return F.element_at(F.split(file_stem(path), "_"), 2)
