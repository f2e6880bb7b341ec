"""The catalog: which tables are prepared, into which partitions, and the bounds of their columns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from math import prod

from pyspark.sql import DataFrame, SparkSession

from ..errors import ProgressiveError

PARTITION_SCHEMA = "src_table string, table_name string, id int, entries long, fact boolean"
COLUMN_SCHEMA = "table string, name string, min double, max double"


@dataclass(frozen=True)
class PartitionMeta:
    src_table: str
    table_name: str
    id: int
    entries: int
    fact: bool


@dataclass(frozen=True)
class ColumnStats:
    """Smallest and largest value of a numeric column over the whole table, without any filter."""

    table: str
    name: str
    min: float
    max: float


@dataclass
class Catalog:
    _partitions: dict[str, list[PartitionMeta]] = field(default_factory=dict)
    _columns: dict[tuple[str, str], ColumnStats] = field(default_factory=dict)

    def put(self, partitions: Iterable[PartitionMeta], columns: Iterable[ColumnStats]) -> None:
        """Add or replace what is known of the tables named in ``partitions``."""
        new: dict[str, list[PartitionMeta]] = {}
        for p in sorted(partitions, key=lambda p: p.id):
            new.setdefault(p.src_table.lower(), []).append(p)
        for name in new:
            self.remove(name)
        self._partitions |= new
        self._columns |= {(c.table.lower(), c.name.lower()): c for c in columns}

    def remove(self, table: str) -> None:
        table = table.lower()
        self._partitions.pop(table, None)
        self._columns = {k: v for k, v in self._columns.items() if k[0] != table}

    def partitions(self, table: str) -> list[PartitionMeta]:
        return list(self._partitions.get(table.lower(), ()))

    def is_fact(self, table: str) -> bool:
        return any(p.fact for p in self.partitions(table))

    def partition_count(self, tables: Iterable[str]) -> int:
        """Steps of a query over ``tables``; a table that is not prepared is one partition."""
        return prod(max(1, len(self.partitions(t))) for t in tables)

    def bounds(self, column: str, tables: Iterable[str]) -> ColumnStats:
        """Bounds of ``column`` or ``table.column``; an unqualified name is looked up in each of ``tables``."""
        parts = column.replace("`", "").lower().split(".")
        if len(parts) > 2:
            raise ProgressiveError(f"{column}: a column has at most a table and a name")
        for t in [parts[0]] if len(parts) == 2 else tables:
            if (t.lower(), parts[-1]) in self._columns:
                return self._columns[t.lower(), parts[-1]]
        raise ProgressiveError(f"no bounds are known of column {column}")

    # --- persistence

    def partitions_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(p).values()) for ps in self._partitions.values() for p in ps], PARTITION_SCHEMA)

    def columns_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(c).values()) for c in self._columns.values()], COLUMN_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        self.partitions_df(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/partitions")
        self.columns_df(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        out = cls()
        out.put(
            (PartitionMeta(**r.asDict()) for r in spark.read.parquet(f"{path}/partitions").collect()),
            (ColumnStats(**r.asDict()) for r in spark.read.parquet(f"{path}/columns").collect()),
        )
        return out
