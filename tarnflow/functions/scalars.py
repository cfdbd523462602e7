"""Small column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def kaprekar_step(n: Column) -> Column:
    """Digits in falling order less digits in rising order, of four digits with leading zeros."""
    digits = F.sort_array(F.split(F.lpad(n.cast("string"), 4, "0"), ""))
    up = F.array_join(digits, "").cast("long")
    return F.reverse(F.array_join(digits, "")).cast("long") - up


def kaprekar(n: Column, rounds: int = 7) -> tuple[Column, Column]:
    """Where the routine ends and after how many steps: 6174, or 0 for equal digits."""
    values = [n.cast("long")]
    for _ in range(rounds):
        values.append(kaprekar_step(values[-1]))
    steps = sum((((v != 6174) & (v != 0)).cast("long") for v in values[:-1]), F.lit(0).cast("long"))
    return values[-1], steps


def near(c: Column, places: int) -> Column:
    """Rounded as DuckDB does, by a product with a power of ten: a double's own arithmetic, much faster than round()'s decimal numbers. Large numbers, null and what isn't finite go to round()."""
    scale = 10.0**places
    return F.when(F.abs(c) < 1e15 / scale, F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale).otherwise(F.round(c, places))
