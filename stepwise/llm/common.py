"""What the operators of this subpackage share: table access, checkpoints, prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming.state import checkpoint, discard, new_folder

__all__ = ["checkpoint", "discard", "hub_join", "kept", "new_folder", "prefix_sums", "shuffle_width", "table"]

#: Rows of one key that are not split, unless more than ``MOST_HUBS`` keys had more of them.
HEAVY, MOST_HUBS = 1_024, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session has them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def kept(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """``df`` as a table written to the shared folder, and the table's folder, which ``discard`` deletes."""
    folder = new_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def hub_join(many: DataFrame, one: DataFrame, on: str | list[str], spread: str | list[str], counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Join ``many`` (cheap to read again) with ``one``, which has a row for each value of ``on``.

    Rows of ``many`` with a frequent value are dealt out by the hash of ``spread``, and that value's row of
    ``one`` is repeated for each of their parts.  Frequent is what has more than ``HEAVY`` rows, or so many
    that at most ``MOST_HUBS`` values can have them, so what is broadcast is bounded.  ``counts``: the
    columns of ``on`` and n, cheap to read again, too.
    """
    on, spread = [on] if isinstance(on, str) else on, [spread] if isinstance(spread, str) else spread
    counts = many.groupBy(*on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts.select(*on, "n")
    known = counts.dropna(subset=on)
    total, most = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    heavy = max(HEAVY, total // MOST_HUBS)
    if most <= heavy:
        return many.join(one, on, how)
    hubs = checkpoint(known.where(F.col("n") > heavy).select(*on, F.ceil(F.col("n") / heavy).cast("int").alias("_parts")))
    few = F.broadcast(hubs)
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    dealt = many.join(few, on, "left").withColumn("_part", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("_parts")
    copies = one.join(few, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [*on, "_part"], how).drop("_part")


def prefix_sums(df: DataFrame, part: str, values: dict[str, Column], order: list[Column]) -> DataFrame:
    """Add, for each named value, its sum over all rows up to and including the current one, and as
    ``<name>_all`` its sum over the whole table.

    ``part`` numbers the range partitions of ``df`` in order.  Each partition is summed by itself
    and gets the totals of the partitions before it, so no task sees more than one partition's rows;
    the only table in one task has a row for each partition.
    """
    totals = df.groupBy(part).agg(*[F.sum(v).cast("long").alias(n) for n, v in values.items()])
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col(part).alias("_of"),
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long").alias(f"{n}_before") for n in values],
        *[F.sum(n).over(everything).cast("long").alias(f"{n}_all") for n in values],
    )
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.select("*", *[F.sum(v).over(inside).cast("long").alias(n) for n, v in values.items()])
    # one row for each shuffle partition, so the broadcast has a bounded size
    sums = sums.join(F.broadcast(totals), sums[part] == totals["_of"]).drop("_of")
    for n in values:
        sums = sums.withColumn(n, F.col(n) + F.col(f"{n}_before")).drop(f"{n}_before")
    return sums
