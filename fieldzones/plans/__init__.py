"""End-to-end jobs and the checked query set.

Importing this package registers every checked query in ``registry.QUERIES`` (Spark)
and ``registry.ORACLES`` (DuckDB oracle text).
"""

from fieldzones.plans import design, field_models, grid_kriging, files, models, preparation, rasters, records, zones, zoning  # noqa: F401
from fieldzones.plans.registry import ORACLES, QUERIES  # noqa: F401
