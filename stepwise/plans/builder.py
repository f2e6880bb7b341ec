"""A fluent way to write progressive selects.

``session.table("lineitem").where("l_tax > 0").group_by("k").agg("avg(x) AS a", confidence("x")).result()``
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from ..session import ProgressiveSession, Result
    from ..streaming.stepper import Snapshot


def avg(expression: str, alias: str | None = None) -> str:
    return _named(f"avg({expression})", alias)


def sum_(expression: str, alias: str | None = None) -> str:
    return _named(f"sum({expression})", alias)


def count(expression: str = "*", alias: str | None = None) -> str:
    return _named(f"count({expression})", alias)


def confidence(column: str, alias: str | None = None) -> str:
    return _named(f"progressive_confidence({column})", alias)


def partition(alias: str | None = None) -> str:
    return _named("progressive_partition()", alias)


def progress(alias: str | None = None) -> str:
    return _named("progressive_progress()", alias)


def _named(text: str, alias: str | None) -> str:
    return f"{text} AS `{alias}`" if alias else text


@dataclass(frozen=True)
class Builder:
    session: ProgressiveSession
    tables: tuple[str, ...]
    conditions: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    items: tuple[str, ...] = ()
    groups: str | None = None
    order: tuple[str, ...] = ()
    rows: int | None = None

    def join(self, table: str, on: str) -> Builder:
        return replace(self, tables=(*self.tables, table), conditions=(*self.conditions, on))

    def where(self, condition: str) -> Builder:
        return replace(self, conditions=(*self.conditions, condition))

    def group_by(self, *keys: str) -> Builder:
        return replace(self, keys=(*self.keys, *keys))

    def agg(self, *items: str) -> Builder:
        return replace(self, items=(*self.items, *items))

    def having(self, condition: str) -> Builder:
        return replace(self, groups=condition)

    def order_by(self, *order: str) -> Builder:
        return replace(self, order=order)

    def limit(self, rows: int) -> Builder:
        return replace(self, rows=rows)

    def sql(self) -> str:
        """The statement; grouping keys come first in the select list."""
        text = f"SELECT PROGRESSIVE {', '.join([*self.keys, *self.items])} FROM {', '.join(self.tables)}"
        if self.conditions:
            text += " WHERE " + " AND ".join(f"({c})" for c in self.conditions)
        if self.keys and self.items:
            text += f" GROUP BY {', '.join(self.keys)}"
        if self.groups:
            text += f" HAVING {self.groups}"
        if self.order:
            text += f" ORDER BY {', '.join(self.order)}"
        return text + (f" LIMIT {self.rows}" if self.rows is not None else "")

    def result(self) -> Result | Any:
        return self.session.sql(self.sql())

    def batch(self) -> DataFrame:
        return self.result().batch()

    def final(self) -> DataFrame:
        return self.result().final()

    def snapshots(self) -> Iterator[Snapshot]:
        return self.result().snapshots()
