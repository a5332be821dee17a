"""Ticks of a chart's axis."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def nice_ticks(top: Column, count: int = 5) -> Column:
    """Evenly spaced ticks from 0 that reach ``top``: a quarter of it, rounded up to twentieths of its own magnitude (tenths below ten).

    [0, 1] for null and what isn't a positive number. A step never has to grow again, since it isn't below its share of the top.
    """
    rough = top.cast("double") / (count - 1)
    digits = F.floor(F.log10(rough)) + 1
    size = F.pow(F.lit(10.0), digits)
    unit = F.when(digits == 1, 0.1).otherwise(0.05)
    step = F.ceil(F.round(rough / size / unit, 9)) * unit * size
    ticks = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.round(i * step, 9))
    return F.when((top > 0) & (F.abs(top.cast("double")) < float("inf")), ticks).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
