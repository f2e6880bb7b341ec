"""Progressive views: one scan that many readers follow."""

from __future__ import annotations

import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..operators.snapshots import STEP
from ..plans.compiler import Plan
from .state import discard, new_folder
from .stepper import Scan


class LiveView:
    """A named view, filled in the background from its creation on.

    Each step reads its partitions and writes their partial states to a folder of its own; nothing else
    is kept.  Readers that follow the view merge the steps written so far.  A reader that wants all of it
    makes the scan hurry: what is left is then read in a single job.  Either way every partition is
    read once, whatever readers there are.
    """

    def __init__(self, name: str, plan: Plan) -> None:
        self.name, self.plan = name, plan
        self.spark = plan.base.sparkSession
        self._schema = plan.partial().schema
        self._folder = new_folder(self.spark, "view")
        self._ends: list[int] = []  # the step after the last one of each written folder
        self._changed = threading.Condition()
        self._error: BaseException | None = None
        self._stopped = self._hurry = False
        self._thread: threading.Thread | None = None
        self._scan = Scan(self.spark)

    def start(self) -> LiveView:
        """Begin to scan, if that has not begun."""
        with self._changed:
            if self._thread is None:
                self._thread = threading.Thread(target=self._fill, name=f"stepwise-{self.name}", daemon=True)
                self._thread.start()
        return self

    def _fill(self) -> None:
        plan = self.plan
        try:
            while not self.done and not self._stopped:
                first, hurry = self.steps_read, self._hurry
                rows = plan.rows(None).where(f"{STEP} >= {first}") if hurry else plan.rows(first)
                end = plan.steps if hurry else first + 1
                with self._scan.working(f"view {self.name}: steps {first + 1} to {end} of {plan.steps}"):
                    plan.partial(rows).write.parquet(f"{self._folder}/{first}")
                with self._changed:
                    self._ends.append(end)
                    self._changed.notify_all()
        except BaseException as error:  # for the readers
            with self._changed:
                self._error = None if self._stopped else error
                self._changed.notify_all()

    @property
    def steps_read(self) -> int:
        return self._ends[-1] if self._ends else 0

    @property
    def done(self) -> bool:
        return self.steps_read == self.plan.steps

    def _written(self, step: int) -> DataFrame:
        """Partial states up to and including ``step``."""
        begins = [0, *self._ends]
        paths = [f"{self._folder}/{begin}" for begin, _ in zip(begins, self._ends, strict=False) if begin <= step]
        return self.spark.read.schema(self._schema).parquet(*paths).where(f"{STEP} <= {step}")

    def partial(self) -> DataFrame:
        """Partial states of all steps; waits for the scan, which reads what is left at once."""
        self._hurry = True
        self.start()
        with self._changed:
            self._changed.wait_for(lambda: self.done or self._error or self._stopped)
            if self._error:
                raise self._error
            return self._written(self.steps_read - 1)

    def follow(self) -> Iterator[tuple[int, DataFrame]]:
        """(step, partial states) from the current step on; a finished view gives its last step only.

        A slow reader gets every step; an error of the scan is raised here.
        """
        self.start()
        with self._changed:
            at = max(0, self.steps_read - 1)
        while at < self.plan.steps:
            with self._changed:
                self._changed.wait_for(lambda: self.steps_read > at or self._error or self._stopped)
                if self.steps_read <= at:
                    if self._error:
                        raise self._error
                    return
                partial = self._written(at)
            yield at, partial
            at += 1

    def stop(self, purge: bool = False) -> None:
        """Stop the scan and its running job; readers end.  ``purge`` deletes what was written."""
        with self._changed:
            self._stopped = True
            self._changed.notify_all()
        if not self.done:
            self._scan.cancel()
        if purge:
            if self._thread is not None and self._thread is not threading.current_thread():
                self._thread.join()
            discard(self.spark, self._folder)
