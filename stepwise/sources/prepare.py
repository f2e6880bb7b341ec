"""Splitting tables into partitions and gathering their statistics."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ProgressiveError
from .catalog import Catalog, ColumnStats, PartitionMeta

PARTITION = "_partition"
#: Rows of a partition unless told otherwise.
DEFAULT_SIZE = 500_000
#: Calibration: first size, wanted milliseconds, tolerance, runs for each size, most sizes tried.
FIRST_SIZE, TARGET_MS, TOLERANCE, RUNS, MOST_SIZES = 1_000_000, 400, 0.1, 5, 12


@dataclass(frozen=True)
class ForeignKey:
    """``column`` of the base table refers to ``ref_column`` of ``table``."""

    column: str
    table: str
    ref_column: str


@dataclass(frozen=True)
class Prepared:
    name: str
    data: DataFrame  # with the column _partition
    partitions: int
    path: str | None = None


def partition_count(rows: int, size: int) -> int:
    """Partitions of at most ``size`` rows each; at least one."""
    if size < 1:
        raise ProgressiveError("the partition size must be positive")
    return max(1, math.ceil(rows / size))


def assign(df: DataFrame, partitions: int, strategy: str = "round_robin", key: str | Sequence[str] | None = None) -> DataFrame:
    """``df`` with ``_partition``, 0 to ``partitions - 1``.

    ``expr``: the SQL expression ``key`` modulo the count.  ``hash``: the hash of the columns ``key``.
    ``round_robin``: the row's number in the order of the columns ``key`` (default: all), so sizes
    differ by one at most.
    """
    if strategy == "expr":
        return df.withColumn(PARTITION, F.expr(f"cast(pmod({key}, {partitions}) AS int)"))
    names = [key] if isinstance(key, str) else list(key or df.columns)
    if strategy == "hash":
        return df.withColumn(PARTITION, F.pmod(F.xxhash64(*names), F.lit(partitions)).cast("int"))
    if strategy != "round_robin":
        raise ProgressiveError(f"unknown strategy {strategy}")
    return _numbered(df, names).withColumn(PARTITION, F.pmod("_row", F.lit(partitions)).cast("int")).drop("_row")


def _numbered(df: DataFrame, names: list[str]) -> DataFrame:
    """Add ``_row``, the row's number from 0 in the order of ``names``, without sorting all rows in one task.

    The rows are range-partitioned and numbered inside each range; a range starts where the row counts
    of the earlier ones end.  The ranges are checkpointed, so a lost executor cannot shift them.
    """
    from ..streaming.state import checkpoint

    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpoint(df.repartitionByRange(width, *names).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").count()
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*names)
    # one row for each range, of which there are as many as shuffle partitions
    return (
        ranged.withColumn("_row", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "_range")
        .withColumn("_row", F.col("_row") + F.col("_start"))
        .drop("_range", "_start")
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != PARTITION]


def column_stats(df: DataFrame, name: str) -> list[ColumnStats]:
    """Bounds of all numeric columns, in one pass; a column without values has none."""
    columns = numeric_columns(df)
    if not columns:
        return []
    row = df.agg(*[F.min(F.col(c).cast("double")).alias(f"a{k}") for k, c in enumerate(columns)], *[F.max(F.col(c).cast("double")).alias(f"b{k}") for k, c in enumerate(columns)]).first()
    return [ColumnStats(name, c, row[f"a{k}"], row[f"b{k}"]) for k, c in enumerate(columns) if row[f"a{k}"] is not None]


def partition_meta(data: DataFrame, name: str, partitions: int, fact: bool) -> list[PartitionMeta]:
    """Row counts of all partitions, empty ones included."""
    sizes = {r[0]: r[1] for r in data.groupBy(PARTITION).count().collect()}  # a row for each partition
    return [PartitionMeta(name, f"{name}_partition_{i}", i, sizes.get(i, 0), fact) for i in range(partitions)]


def prepare_table(
    catalog: Catalog,
    df: DataFrame,
    name: str,
    *,
    partitions: int | None = None,
    partition_size: int | None = None,
    strategy: str = "round_robin",
    key: str | Sequence[str] | None = None,
    fact: bool = True,
    path: str | None = None,
) -> Prepared:
    """Split ``df`` into partitions and enter it into the catalog, replacing an earlier entry.

    With ``path`` the partitions are written as a Parquet dataset, one file for each, and later reads
    of a partition touch its file only; without it the partition is a column computed while scanning.
    """
    if partitions is None:
        partitions = partition_count(df.count(), partition_size or DEFAULT_SIZE)
    data = assign(df, partitions, strategy, key)
    if path:
        data.repartition(partitions, PARTITION).write.mode("overwrite").partitionBy(PARTITION).parquet(path)
        data = df.sparkSession.read.schema(data.schema).parquet(path)
    catalog.put(partition_meta(data, name, partitions, fact), column_stats(data, name))
    return Prepared(name, data, partitions, path)


def calibrate_partition_size(
    df: DataFrame,
    dimensions: Sequence[tuple[ForeignKey, DataFrame]] = (),
    n_groups: int = 5,
    target_ms: float = TARGET_MS,
    first_size: int = FIRST_SIZE,
) -> int:
    """The number of rows over which an average over the joined ``dimensions`` takes about ``target_ms``.

    The average of a numeric column is grouped by ``n_groups`` columns, or as many as there are
    dimensions if these are more; each foreign key joins its table.  Each size is timed as the mean of
    ``RUNS`` runs and scaled to the target; two leading digits of the new size are kept.  The search ends
    within ``TOLERANCE`` of the target, when the whole table is faster, when a size comes again, or after
    ``MOST_SIZES`` sizes.  The rows of a size are those with the smallest hashes, which every task picks
    by itself.
    """
    numeric = numeric_columns(df)
    if not numeric:
        raise ProgressiveError("calibration needs a numeric column")
    plain = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.DateType, T.TimestampType)) and f.name != PARTITION]
    groups = (plain + [c for c in numeric if c != numeric[0]])[: max(n_groups, len(dimensions))]
    rows, size, seen = df.count(), first_size, set()
    for _ in range(MOST_SIZES):
        sample = df
        if size < rows:
            mark = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(1 << 30))
            sample = df.where(mark < F.lit(int((1 << 30) * size / rows)))
        for k, (fk, table) in enumerate(dimensions):
            other = table.select(F.col(fk.ref_column).alias(f"_ref{k}"))
            sample = sample.join(other, sample[fk.column] == other[f"_ref{k}"])
        began = time.perf_counter()
        for _ in range(RUNS):
            sample.groupBy(*groups).agg(F.avg(numeric[0])).write.format("noop").mode("overwrite").save()
        ms = (time.perf_counter() - began) * 1000 / RUNS
        if abs(ms - target_ms) <= TOLERANCE * target_ms or size in seen or (size >= rows and ms < target_ms):
            break
        seen.add(size)
        size = two_digits(size * target_ms / ms)
    return size


def two_digits(value: float) -> int:
    """``value`` cut down to its two leading digits; at least one."""
    whole = max(1, int(value))
    scale = 10 ** max(0, len(str(whole)) - 2)
    return whole // scale * scale
