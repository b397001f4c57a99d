"""Rounding half to even. Decimals are rounded on the binary value, as IEEE formatting does.

Spark's ``round`` and ``bround`` look at the shortest decimal text of a double, so that 70.35,
stored as 70.3499..., would go up. Its ``format_number`` with a pattern looks at the exact value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_text(value: Column, places: int) -> Column:
    """Text with exactly ``places`` decimals, such as ``%.1f`` gives."""
    pattern = "0." + "0" * places if places else "0"
    text = F.call_function("format_number", value, F.lit(pattern))
    # half a unit of the last place is the one number that format_number gets wrong
    half = 0.5 / 10**places
    told = f"{half:.{places}f}"
    return (
        F.when(F.isnan(value), "nan")
        .when(value == half, told)
        .when(value == -half, f"-{told}")
        .otherwise(text)
    )


def round_places(value: Column, places: int) -> Column:
    """``value`` as a double rounded to ``places`` decimals."""
    return fixed_text(value, places).cast("double")


def whole_degree(value: Column) -> Column:
    """The nearest whole number as bigint, half to even."""
    return F.bround(value, 0).cast("bigint")
