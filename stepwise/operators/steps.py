"""The step in which a combination of partitions is read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def step_of(partitions: Sequence[tuple[str, int]]) -> Column:
    """Mixed-radix number of a row from (partition column, partition count) of each table.

    The first table runs fastest; tables of one partition don't count.
    """
    step, weight = F.lit(0), 1
    for column, count in partitions:
        if count > 1:
            step = step + F.col(column) * weight
            weight *= count
    return step.cast("int")


def partitions_of(step: int, counts: Sequence[int]) -> list[int]:
    """The partition of each table that ``step`` reads."""
    out = []
    for count in counts:
        out.append(step % count)
        step //= count
    return out
