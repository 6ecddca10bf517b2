"""Column expressions: text rules, numeric rules, planar geometry, coordinate systems."""

from fieldzones.functions.numeric import (arange, argmax, as_int, distance, linspace,  # noqa: F401
                                          nan_to_null, round_even, to_number)
from fieldzones.functions.text import (as_text, blank_nan, file_name, file_stem,  # noqa: F401
                                       layer_name, report_code, strip, zfill, zone_code)
