"""Snapshots one step at a time."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.snapshots import STEP, merge_states, one_snapshot
from ..plans.compiler import Plan
from .state import checkpoint

log = logging.getLogger("stepwise")

#: Scans that read at a time, whatever statement they belong to.
MAX_SCANS = 5
slots = threading.BoundedSemaphore(MAX_SCANS)


@dataclass(frozen=True)
class Snapshot:
    """The answer after ``partition`` steps; ``progress`` is the part of all steps."""

    partition: int
    progress: float
    df: DataFrame

    def to_json(self) -> list[str]:
        """The rows as JSON texts, for a client."""
        return self.df.toJSON().collect()


class Scan:
    """What the jobs of one scan have in common: a slot while they run, a tag, and that they can be cancelled."""

    def __init__(self, spark: SparkSession) -> None:
        self.context, self.tag, self.cancelled = spark.sparkContext, f"stepwise-{uuid.uuid4().hex}", False

    @contextmanager
    def working(self, what: str) -> Iterator[None]:
        with slots:
            began = time.perf_counter()
            self.context.addJobTag(self.tag)
            try:
                yield
            finally:
                self.context.removeJobTag(self.tag)
            log.info("%s in %d ms", what, (time.perf_counter() - began) * 1000)

    def cancel(self) -> None:
        """Stop the job that is running; no other one follows."""
        self.cancelled = True
        self.context.cancelJobsWithTag(self.tag)


def states_by_step(plan: Plan, scan: Scan) -> Iterator[tuple[int, DataFrame]]:
    """(step, state): the merged state (all keys and flags) after each step.

    Each step reads its partitions only, merges their states into the last ones and cuts the lineage.
    """
    every = [*plan.keys, *plan.future_keys, *plan.flag_words]
    states, merged = list(plan.states.values()), None
    for step in range(plan.steps):
        partial = plan.partial(plan.rows(step)).drop(STEP)
        both = partial if merged is None else merged.unionByName(partial)
        both = merge_states(both, every, states) if every else both.agg(*[s.merge().alias(s.name) for s in states]) if states else both
        try:
            with scan.working(f"step {step + 1} of {plan.steps}"):
                merged = checkpoint(both)
        except Exception:
            if scan.cancelled:
                return
            raise
        if scan.cancelled:
            return
        yield step, merged


def step_by_step(plan: Plan, scan: Scan) -> Iterator[Snapshot]:
    for step, merged in states_by_step(plan, scan):
        reduced = plan.reduced(merged, None, (), with_step=False)
        states = one_snapshot(reduced, plan.group_columns(), list(plan.states.values()), step)
        yield Snapshot(step + 1, (step + 1) / plan.steps, plan.finish(plan.read_out(states)))
