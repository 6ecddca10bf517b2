"""Numeric rules (F8-F14, P5) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text accepted as a number by pandas ``to_numeric``: optional sign, digits with an
# optional fraction, optional exponent, surrounding blanks.  ``5d`` (a double literal for
# Spark's cast), ``1_000`` (accepted by some SQL engines), ``inf`` and ``nan`` are refused.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(c, digits: int = 0) -> Column:
    """NumPy/pandas ``round``: half to even on the scaled value."""
    scale = float(10 ** digits)
    return F.rint(_c(c) * F.lit(scale)) / F.lit(scale)


def to_number(c) -> Column:
    """``pd.to_numeric(errors='coerce')``: text that is not a plain number becomes null."""
    c = _c(c)
    s = c.cast("string")
    return F.when(s.rlike(NUMBER_PATTERN), F.trim(s).try_cast("double"))


def nan_to_null(c) -> Column:
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def distance(x1, y1, x2, y2) -> Column:
    """Euclidean distance as ``sqrt(dx*dx + dy*dy)`` (same operation order as the oracle)."""
    dx = _c(x1) - _c(x2)
    dy = _c(y1) - _c(y2)
    return F.sqrt(dx * dx + dy * dy)


def arange(start, stop, step) -> Column:
    """``np.arange`` for doubles: ``start + i*step`` for i < ceil((stop-start)/step)."""
    start, stop, step = _c(start), _c(stop), _c(step)
    n = F.ceil((stop - start) / step).cast("int")
    return F.when(n <= 0, F.array().cast("array<double>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + i * step))


def linspace(start, stop, num) -> Column:
    """``np.linspace``: ``num`` points, both ends included; one point gives ``start``."""
    start, stop, num = _c(start), _c(stop), _c(num)
    step = (stop - start) / (num - 1)
    return (F.when(num <= 0, F.array().cast("array<double>"))
            .when(num == 1, F.array(start.cast("double")))
            .otherwise(F.transform(F.sequence(F.lit(0), num - 1), lambda i: start + i * step)))


def argmax(arr) -> Column:
    """0-based index of the greatest element, the first one on ties (``np.argmax``)."""
    arr = _c(arr)
    return F.array_position(arr, F.array_max(arr)).cast("int") - 1


def as_int(c) -> Column:
    """Python ``int()`` on a double: truncation toward zero."""
    return _c(c).cast("int")
