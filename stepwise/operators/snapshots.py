"""From partial states of steps to the states of snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP, SNAP = "_step", "_snap"


@dataclass(frozen=True)
class State:
    """A mergeable state: ``kind`` is sum, count, min, max or distinct (a sketch) of the SQL expression ``argument``."""

    name: str
    kind: str
    argument: str

    def partial(self) -> Column:
        argument = F.lit(1) if self.argument == "*" else F.expr(self.argument)
        return {"distinct": F.hll_sketch_agg}.get(self.kind, getattr(F, self.kind, None))(argument).alias(self.name)

    def merge(self) -> Column:
        """The function that merges states; sums and counts ignore nulls, so a step without values adds nothing."""
        return {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "distinct": F.hll_union_agg}[self.kind](F.col(self.name))


def merge_states(partial: DataFrame, keys: Sequence[str], states: Sequence[State]) -> DataFrame:
    """Add up the states of rows that agree in ``keys``."""
    if not states:
        return partial.select(*keys).distinct()
    return partial.groupBy(*keys).agg(*[s.merge().alias(s.name) for s in states])


def all_snapshots(partial: DataFrame, keys: Sequence[str], states: Sequence[State], steps: int) -> DataFrame:
    """(_snap, keys, states): the state after every step, from ``partial`` (_step, keys, states).

    Within a group the states are accumulated in the order of the steps, and each total holds until the
    group's next step: a group is in every snapshot from its first step on, and the only rows made are
    those of the result.  Without keys there is a row for every step.
    """
    if not keys:
        every = partial.sparkSession.range(steps).select(F.col("id").cast("int").alias(STEP))
        partial = every.join(partial, STEP, "left")
    group = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(STEP)
    if states:
        upto = group.rowsBetween(Window.unboundedPreceding, 0)
        rows = partial.select(STEP, *keys, *[s.merge().over(upto).alias(s.name) for s in states], F.lead(STEP).over(group).alias("_next"))
    else:  # a running DISTINCT: a row stays from its first step on
        rows = partial.groupBy(*keys).agg(F.min(STEP).alias(STEP)).withColumn("_next", F.lit(None).cast("int"))
    until = F.coalesce("_next", F.lit(steps)) - 1
    rows = rows.withColumn(SNAP, F.explode(F.sequence(F.col(STEP), until)))
    counts = [F.coalesce(s.name, F.lit(0)).alias(s.name) if s.kind == "count" else F.col(s.name) for s in states]
    return rows.select(SNAP, *keys, *counts)


def one_snapshot(state: DataFrame, keys: Sequence[str], states: Sequence[State], step: int) -> DataFrame:
    """The same for a single snapshot, from the merged state (keys, states) after ``step``."""
    rows = state
    if not keys:
        single = state.sparkSession.range(1).select(F.lit(0).alias("_one"))
        rows = single.join(state.withColumn("_one", F.lit(0)), "_one", "left").drop("_one")
    counts = [F.coalesce(s.name, F.lit(0)).alias(s.name) if s.kind == "count" else F.col(s.name) for s in states]
    return rows.select(F.lit(step).alias(SNAP), *keys, *counts)


def grouping_sets(partial: DataFrame, keys: Sequence[str], kind: str, sets: Sequence[Sequence[int]] = ()) -> DataFrame:
    """``partial`` repeated for each grouping set, with ``_grouping`` telling them apart.

    ``kind`` is ROLLUP, CUBE or SETS; for the last one ``sets`` has the places of each set's keys.
    """
    n = len(keys)
    if kind == "SETS":
        masks = [sum(1 << (n - 1 - k) for k in range(n) if k not in s) for s in sets]
    else:
        masks = [(1 << k) - 1 for k in range(n + 1)] if kind == "ROLLUP" else list(range(1 << n))
    types = dict(partial.dtypes)

    def keyed(number: int, mask: int) -> Column:
        # a set that comes twice gives its rows twice
        out = [F.lit(number if kind == "SETS" else mask).alias("_grouping")]
        for place, key in enumerate(keys):
            gone = mask >> (n - 1 - place) & 1
            out.append((F.lit(None).cast(types[key]) if gone else F.col(key)).alias(key))
        return F.struct(*out)

    rest = [c for c in partial.columns if c not in keys]
    return partial.select(*rest, F.explode(F.array(*[keyed(k, m) for k, m in enumerate(masks)])).alias("_keys")).select(*rest, "_keys.*")


def top_per_snapshot(snapshots: DataFrame, order: Sequence[Column], limit: int | None, offset: int) -> DataFrame:
    """The rows from ``offset`` to ``offset + limit`` of each snapshot."""
    if limit is None and not offset:
        return snapshots
    # without an order the rows are taken in that of all columns, so that every run gives the same ones
    place = F.row_number().over(Window.partitionBy(SNAP).orderBy(*(order or [F.col(c) for c in snapshots.columns if c != SNAP])))
    ranked = snapshots.withColumn("_place", place)
    if limit is not None:
        ranked = ranked.where(F.col("_place") <= offset + limit)
    return ranked.where(F.col("_place") > offset).drop("_place")
