"""Plain files: pipe-delimited loads and result files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "|") -> DataFrame:
    """A delimited file without header, in which an empty field is NULL."""
    return spark.read.csv(path, schema=schema, sep=sep, nullValue="", header=False)


def write_results(df: DataFrame, path: str, sep: str = ";") -> None:
    """``df`` as delimited text with a header, NULL as an empty field."""
    df.write.mode("overwrite").csv(path, sep=sep, header=True, nullValue="", emptyValue="")


def report_lines(rows: Iterable[Sequence[object]], sep: str = ";") -> str:
    """A benchmark report: query, base time, sum over the partitions, mean of the partitions."""
    # fixed values: the columns that such a report has
    head = ("Query", "Base", "Partitions Sum", "Partitions Avg")
    return "".join(sep.join(map(str, r)) + "\n" for r in [head, *rows])


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1, **options: str
) -> DataFrame:
    """A table of another database, whose driver must be on Spark's class path.

    With a number ``column`` and its ``bounds`` the table is read in so many ranges at a time; rows beyond
    the bounds belong to the first and the last range.
    """
    if column and bounds:
        options |= {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    """``df`` as a table of another database, replacing one of that name."""
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("overwrite").save()
