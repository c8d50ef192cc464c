"""Fixed-point text and rounding of doubles, correct to the last binary digit.

``format_string`` and ``round`` work on the shortest decimal form of a double and round
halves up; reports need the exact value with halves to even (1.25 is ``1.2``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two_sum(a: Column, b: Column) -> tuple[Column, Column]:
    """Sum and its rounding error."""
    s = a + b
    part = s - a
    return s, (a - (s - part)) + (b - part)


def fixed(x: Column, digits: int, signed: bool = False) -> Column:
    """``x`` with one or two digits after the point; NULL stays NULL, infinity is ``inf``."""
    size = F.abs(x.cast("double"))
    if digits == 1:  # ten times x without error: 8x + 2x
        scaled, error = _two_sum(size * 8, size * 2)
    elif digits == 2:  # a hundred times x: 64x + 32x + 4x
        first, error_1 = _two_sum(size * 64, size * 32)
        scaled, error_2 = _two_sum(first, size * 4)
        error = error_1 + error_2
    else:
        raise ValueError("digits must be 1 or 2")
    finite = size < F.lit(1e15)
    below = F.when(finite, F.floor(scaled)).otherwise(F.lit(0))
    beyond_half = (scaled - below - 0.5) + error
    up = (beyond_half > 0) | ((beyond_half == 0) & (below % 2 == 1))
    units = below + F.when(up, 1).otherwise(0)
    scale = 10**digits
    whole = F.floor(units / F.lit(scale)).cast("string")
    part = F.lpad((units % scale).cast("string"), digits, "0")
    sign = F.when(x < 0, "-").otherwise("+" if signed else "")
    text = F.when(finite, F.concat_ws(".", whole, part)).when(
        size == F.lit(float("inf")), F.lit("inf")
    ).otherwise(F.format_string(f"%.{digits}f", size))
    return F.concat(sign, F.when(size.isNotNull(), text))


def rounded(x: Column, digits: int = 2) -> Column:
    """``x`` rounded to one or two digits, as a double."""
    return fixed(x, digits).cast("double")
