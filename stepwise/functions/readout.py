"""Estimates from partial states."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence of the interval around an average.
CONFIDENCE = 0.95


def half_width(low: float, high: float, count: Column, confidence: float = CONFIDENCE) -> Column:
    """Hoeffding half-width of the mean of ``count`` values between ``low`` and ``high``; infinite for none."""
    factor = F.lit(1.0) / (F.lit(2.0) * count.cast("double")) * F.log(F.lit(2.0) / (F.lit(1.0) - F.lit(confidence)))
    return F.when(count > 0, F.lit(float(high) - float(low)) * F.sqrt(factor)).otherwise(F.lit(math.inf))


def average(total: Column, count: Column) -> Column:
    """Mean from a sum and a count; null if there is nothing to average."""
    return F.when(count > 0, total.cast("double") / count.cast("double"))


def scaled(total: Column, progress: Column) -> Column:
    """Estimate of the whole from the part that ``progress`` has seen."""
    return total.cast("double") / progress
