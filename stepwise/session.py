"""The engine's entry point: sessions that run progressive SQL on Spark."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ProgressiveError
from .operators.snapshots import SNAP, STEP, all_snapshots
from .operators.steps import partitions_of, step_of
from .plans.builder import Builder
from .plans.compiler import Plan, compile_select
from .plans.lexer import Token, split, tokenize
from .plans.reader import ViewReader
from .plans.statements import Analyze, CreateView, DropView, Plain, Prepare, Select, parse
from .sources.catalog import Catalog
from .sources.prepare import PARTITION, ForeignKey, Prepared, calibrate_partition_size, column_stats, partition_meta, prepare_table
from .streaming.live import LiveView
from .streaming.state import shared_folder
from .streaming.stepper import Scan, Snapshot, step_by_step
from .streaming.stream import stream_snapshots

log = logging.getLogger("stepwise")


@dataclass
class Result:
    """A compiled progressive select.  Nothing runs before one of its methods is called."""

    plan: Plan
    _scans: list[Scan] = field(default_factory=list, repr=False)

    def batch(self, ordered: bool = True, with_snap: bool = False) -> DataFrame:
        """All snapshots, one after the other, in one Spark job."""
        return self.plan.finish(self.plan.snapshots(self.plan.partial()), ordered=ordered, with_snap=with_snap)

    def final(self, ordered: bool = True) -> DataFrame:
        """The last snapshot, which is the exact answer."""
        plan = self.plan
        states = list(plan.states.values())
        # one step instead of all: what is read is the whole table
        partial = plan.partial(plan.base.withColumn(STEP, F.lit(0)))
        whole = all_snapshots(plan.reduced(partial, None, ()), plan.group_columns(), states, 1)
        return plan.finish(plan.read_out(whole.withColumn(SNAP, F.lit(plan.steps - 1))), ordered=ordered)

    def snapshots(self) -> Iterator[Snapshot]:
        """One snapshot after the other, each from a Spark job of its own; closing the iterator stops the rest."""
        self._scans.append(Scan(self.plan.base.sparkSession))
        return step_by_step(self.plan, self._scans[-1])

    def cancel(self) -> None:
        """Stop what ``snapshots`` runs, its current job included; its iterators end."""
        for scan in self._scans:
            scan.cancel()

    def stream(self, path: str) -> Iterator[Snapshot]:
        """The same from a file stream over the prepared table at ``path``, one partition a micro-batch."""
        return stream_snapshots(self.plan, path)


#: Rows of a table that may be joined without an equality, which every row of the others then meets.
MOST_UNLINKED = 1_000_000


class ProgressiveSession:
    """Tables, catalog and views on top of a SparkSession.

    ``storage`` is the folder in which PREPARE TABLE writes partitions, by default in the shared one.
    """

    def __init__(self, spark: SparkSession, storage: str | None = None) -> None:
        self.spark, self.storage = spark, storage
        self.catalog = Catalog()
        self.tables: dict[str, DataFrame] = {}
        self.prepared: dict[str, Prepared] = {}
        self.foreign_keys: dict[str, list[ForeignKey]] = {}
        self.views: dict[str, LiveView] = {}

    # --- tables

    def register(self, name: str, df: DataFrame, foreign_keys: Sequence[ForeignKey] = ()) -> None:
        """Make ``df`` known as a table."""
        self.tables[name.lower()] = df
        self.foreign_keys[name.lower()] = list(foreign_keys)
        df.createOrReplaceTempView(name)

    def prepare_table(
        self,
        name: str,
        *,
        partitions: int | None = None,
        partition_size: int | str | None = None,
        strategy: str = "round_robin",
        key: str | Sequence[str] | None = None,
        path: str | None = None,
        with_foreign_tables: bool = False,
    ) -> Prepared:
        """Split a registered table and, if asked, the tables its foreign keys name (by the same size).

        A ``partition_size`` of ``"auto"`` is measured over the join with these tables.
        """
        df = self._table(name)
        if partition_size == "auto":
            keys = self.foreign_keys.get(name.lower(), [])
            partition_size = calibrate_partition_size(df, [(fk, self._table(fk.table)) for fk in keys])
        self.prepared[name.lower()] = out = prepare_table(
            self.catalog, df, name, partitions=partitions, partition_size=partition_size, strategy=strategy, key=key, path=path
        )
        if with_foreign_tables:
            for fk in self.foreign_keys.get(name.lower(), []):
                self.prepare_dimension(fk.table, partition_size=partition_size, path=f"{path}-{fk.table.lower()}" if path else None)
        return out

    def prepare_dimension(
        self,
        name: str,
        *,
        partitions: int | None = None,
        partition_size: int | None = None,
        strategy: str = "round_robin",
        key: str | Sequence[str] | None = None,
        path: str | None = None,
    ) -> Prepared:
        self.prepared[name.lower()] = out = prepare_table(
            self.catalog, self._table(name), name, partitions=partitions, partition_size=partition_size, strategy=strategy, key=key, fact=False, path=path
        )
        return out

    def analyze(self, name: str) -> None:
        """Gather the statistics of a prepared table anew: the rows of its partitions, the bounds of its columns."""
        ready = self.prepared.get(name.lower())
        if ready is None:
            raise ProgressiveError(f"{name} is not prepared")
        if ready.path:  # files may have come or gone
            ready = replace(ready, data=self.spark.read.schema(ready.data.schema).parquet(ready.path))
            self.prepared[name.lower()] = ready
        fact = self.catalog.is_fact(name)
        self.catalog.put(partition_meta(ready.data, name, ready.partitions, fact), column_stats(ready.data, name))

    def _table(self, name: str) -> DataFrame:
        if name.lower() not in self.tables:
            raise ProgressiveError(f"no table {name}")
        return self.tables[name.lower()]

    # --- statements

    def table(self, *names: str) -> Builder:
        """Begin a progressive select over tables or a view."""
        return Builder(self, names)

    def sql(self, text: str) -> Result | ViewReader | LiveView | Prepared | DataFrame | None:
        """Run or compile a statement; what is not progressive goes to Spark SQL."""
        began = time.perf_counter()
        try:
            return self._run(text)
        finally:
            log.info("%s [%d ms to compile]", " ".join(text.split()), (time.perf_counter() - began) * 1000)

    def _run(self, text: str) -> Result | ViewReader | LiveView | Prepared | DataFrame | None:
        statement = parse(text)
        if isinstance(statement, Plain):
            return self.spark.sql(statement.text)
        if isinstance(statement, Prepare):
            folder = self.storage or f"{shared_folder(self.spark)}/prepared"
            return self.prepare_table(statement.table, with_foreign_tables=True, path=f"{folder}/{statement.table.lower()}-{uuid.uuid4().hex}")
        if isinstance(statement, Analyze):
            return self.analyze(statement.table)
        if isinstance(statement, CreateView):
            return self.create_view(statement)
        if isinstance(statement, DropView):
            return self.drop_view(statement.name, statement.if_exists)
        if len(statement.sources) == 1 and statement.sources[0].table.lower() in self.views:
            return ViewReader(self.views[statement.sources[0].table.lower()], statement)
        if statement.future_where or statement.future_group_by:
            raise ProgressiveError("WITH FUTURE needs a progressive view")
        return Result(self.compile(statement))

    def batch(self, text: str, ordered: bool = True) -> DataFrame:
        """All snapshots of a progressive select over tables or a view."""
        result = self.sql(text)
        if not isinstance(result, Result | ViewReader):
            raise ProgressiveError("this is not a progressive select")
        return result.batch(ordered=ordered)

    def create_view(self, statement: CreateView) -> LiveView:
        name = statement.name.lower()
        if name in self.views:
            if not statement.replace:
                raise ProgressiveError(f"view {statement.name} exists")
            self.views.pop(name).stop()  # results that read it may be in use
        plan = self.compile(statement.select, in_view=True)
        if statement.columns:
            if len(statement.columns) != len(plan.items):
                raise ProgressiveError("the column list does not match the select list")
            for item, column in zip(plan.items, statement.columns, strict=True):
                item.name = column
        self.views[name] = view = LiveView(statement.name, plan).start()
        return view

    def drop_view(self, name: str, if_exists: bool = False) -> None:
        view = self.views.pop(name.lower(), None)
        if view is None and not if_exists:
            raise ProgressiveError(f"no view {name}")
        if view is not None:
            view.stop(purge=True)

    def compile(self, select: Select, in_view: bool = False) -> Plan:
        """The plan of a select over prepared tables."""
        names = [s.table for s in select.sources]
        if not any(self.catalog.is_fact(n) for n in names):
            raise ProgressiveError(f"none of {', '.join(names)} is a prepared fact table")
        frames, counts, labels = [], [], set()
        for k, source in enumerate(select.sources):
            label = (source.alias or source.table).lower()
            if label in labels:
                raise ProgressiveError(f"{label} comes twice; give an alias")
            labels.add(label)
            ready = self.prepared.get(source.table.lower())
            df = ready.data.withColumnRenamed(PARTITION, f"_p{k}") if ready else self._table(source.table)
            if ready:
                counts.append((f"_p{k}", ready.partitions))
            frames.append((not self.catalog.is_fact(source.table), k, df, source.alias or source.table))
        self._check_products(select, [(df, name) for _, _, df, name in frames])
        # The fact table comes first, so that each join meets a condition in WHERE that links it to the rest.
        frames.sort(key=lambda f: f[:2])

        def joined(step: int | None) -> DataFrame:
            """The rows of a step, of which each table gives one partition, or all rows."""
            places = {} if step is None else dict(zip([c for c, _ in counts], partitions_of(step, [n for _, n in counts]), strict=True))
            out = None
            for _, k, df, name in frames:
                if f"_p{k}" in places:
                    df = df.where(F.col(f"_p{k}") == places[f"_p{k}"])
                out = df.alias(name) if out is None else out.join(df.alias(name))
            return out.withColumn(STEP, step_of(counts) if step is None else F.lit(step))

        return compile_select(select, self.catalog, names, joined, self.catalog.partition_count(names), in_view)

    def _check_products(self, select: Select, frames: list[tuple[DataFrame, str]]) -> None:
        """Tables that no equality links to the others must be small, but for the largest group of linked ones."""
        groups = [{k} for k in range(len(frames))]
        for part in split(tokenize(select.where or ""), "AND"):
            if any(t.text == "=" for t in part):
                met = _tables_of(part, frames)
                joined = [g for g in groups if g & met]
                groups = [g for g in groups if not g & met] + ([set().union(*joined)] if joined else [])
        for group in sorted(groups, key=lambda g: (any(self.catalog.is_fact(select.sources[k].table) for k in g), len(g)))[:-1]:
            for k in group:
                df, name = frames[k]
                log.warning("%s is joined without an equality", name)
                if df.limit(MOST_UNLINKED + 1).count() > MOST_UNLINKED:
                    raise ProgressiveError(f"{name} has over {MOST_UNLINKED} rows and is joined without an equality")


def _tables_of(tokens: list[Token], frames: list[tuple[DataFrame, str]]) -> set[int]:
    """The tables whose columns an expression names."""
    out = set()
    for k, t in enumerate(tokens):
        if t.kind not in ("word", "quoted"):
            continue
        after = k + 1 < len(tokens) and tokens[k + 1].text == "."
        before = k > 0 and tokens[k - 1].text == "."
        for n, (df, name) in enumerate(frames):
            if (after and t.name.lower() == name.lower()) or (not after and not before and t.name.lower() in {c.lower() for c in df.columns}):
                out.add(n)
    return out
