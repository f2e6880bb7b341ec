"""Reading a progressive view: activation of futures, then ordinary SQL over each snapshot."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..errors import ProgressiveError
from ..operators.snapshots import SNAP, all_snapshots, one_snapshot
from . import futures
from .compiler import normal
from .lexer import depths, enclosed, span, tokenize
from .statements import Select

if TYPE_CHECKING:
    from ..streaming.live import LiveView
    from ..streaming.stepper import Snapshot

#: Spark aggregates that make an outer select an aggregating one.
OUTER_AGGREGATES = {"SUM", "COUNT", "AVG", "MIN", "MAX", "STDDEV", "VARIANCE", "MEDIAN", "FIRST", "LAST", "COLLECT_LIST", "COLLECT_SET", "APPROX_COUNT_DISTINCT"}


def _bare(text: str) -> str:
    """``text`` without parentheses around it."""
    tokens = tokenize(text)
    while enclosed(tokens):
        tokens = tokens[1:-1]
    return span(text, tokens)


@dataclass
class ViewReader:
    view: LiveView
    select: Select

    def __post_init__(self) -> None:
        plan = self.view.plan
        names = {i.name.lower(): i.key for i in plan.items if i.kind == "future"}
        names |= {normal(e): c for c, e in plan.future_keys.items()}
        self.active = []
        for text in self.select.future_group_by:
            if normal(text) not in names:
                raise ProgressiveError(f"{text} is no FUTURE key of {self.view.name}")
            self.active.append(names[normal(text)])
        nodes = [n for n in futures.flags(plan.tree) if isinstance(n, futures.Future)]
        chosen: set[int] = set()
        for text in self.select.future_where:
            hits = [n for n in nodes if normal(n.text) == normal(_bare(text))] or [n for n in nodes if self._same(n.text, text)]
            if not hits:
                raise ProgressiveError(f"{text} is no FUTURE predicate of {self.view.name}")
            chosen |= {id(n) for n in hits}
        self.condition = futures.activation(plan.tree, plan.flag_of, lambda n: id(n) in chosen)
        # active keys come after all other columns
        self.columns = [i for i in plan.items if i.kind != "future"] + [i for i in plan.items if i.kind == "future" and i.key in self.active]
        inactive = {i.name.lower() for i in plan.items if i.kind == "future" and i.key not in self.active}
        shown = {i.name.lower() for i in self.columns}
        for item in [*self.select.items, *self.select.group_by]:
            if normal(item.text) in inactive - shown:
                raise ProgressiveError(f"{item.text} is a FUTURE key that is not active")

    def _same(self, one: str, other: str) -> bool:
        """Whether two predicates mean the same, as far as Spark can tell."""
        base = self.view.plan.base
        try:
            return base.where(one).sameSemantics(base.where(_bare(other)))
        except AnalysisException:
            return False

    # --- snapshots

    def _named(self, read: DataFrame) -> DataFrame:
        shown = [i for i in self.view.plan.items if i.kind != "future" or i.key in self.active]
        at = {id(i): k for k, i in enumerate(shown)}
        return read.select(SNAP, *[F.col(f"_i{at[id(i)]}").alias(i.name) for i in self.columns])

    def _inner(self, states: DataFrame) -> DataFrame:
        plan = self.view.plan
        read = plan.read_out(states, self.active)
        return self._named(read.where(plan.rewrite(plan.select.having)) if plan.select.having else read)

    def batch(self, ordered: bool = True, with_snap: bool = False) -> DataFrame:
        """All snapshots of the view as this reader sees them, in one job."""
        plan = self.view.plan
        reduced = plan.reduced(self.view.partial(), self.condition, self.active)
        states = all_snapshots(reduced, plan.group_columns(self.active), list(plan.states.values()), plan.steps)
        return self._outer(self._inner(states), ordered, with_snap)

    def final(self, ordered: bool = True) -> DataFrame:
        plan = self.view.plan
        merged = plan.reduced(self.view.partial(), self.condition, self.active, with_step=False)
        states = one_snapshot(merged, plan.group_columns(self.active), list(plan.states.values()), plan.steps - 1)
        return self._outer(self._inner(states), ordered, False)

    def snapshots(self) -> Iterator[Snapshot]:
        """The view's snapshots while it runs: the current one at once, then all later ones."""
        from ..streaming.stepper import Snapshot

        plan = self.view.plan
        for step, partial in self.view.follow():
            merged = plan.reduced(partial, self.condition, self.active, with_step=False)
            states = one_snapshot(merged, plan.group_columns(self.active), list(plan.states.values()), step)
            yield Snapshot(step + 1, (step + 1) / plan.steps, self._outer(self._inner(states), True, False))

    # --- SQL over each snapshot

    def _outer(self, inner: DataFrame, ordered: bool, with_snap: bool) -> DataFrame:
        s = self.select
        star = len(s.items) == 1 and s.items[0].text == "*"
        aggregating = bool(s.group_by) or any(self._aggregates(i.text) for i in s.items)
        if star and aggregating:
            raise ProgressiveError("* cannot be grouped")
        name = f"_view_{uuid.uuid4().hex}"
        inner.createOrReplaceTempView(name)
        columns = ", ".join(f"`{c}`" for c in inner.columns[1:]) if star else ", ".join(
            self._text(i.text) + (f" AS `{i.alias}`" if i.alias else self._default_name(i.text)) for i in s.items
        )
        text = f"SELECT {SNAP}, {columns} FROM {name}"
        if s.where:
            text += f" WHERE {self._text(s.where)}"
        if aggregating:
            text += " GROUP BY " + ", ".join([SNAP, *[self._text(g.text) for g in s.group_by]])
        elif s.distinct:
            text = text.replace("SELECT", "SELECT DISTINCT", 1)
        if s.having:
            text += f" HAVING {self._text(s.having)}"
        order = [self._text(o.text) + (" DESC" if o.descending else "") + (f" NULLS {o.nulls}" if o.nulls else "") for o in s.order_by]
        if s.limit is not None or s.offset:
            outputs = {normal(i.alias or i.text) for i in s.items} | ({c.lower() for c in inner.columns} if star else set())
            extra = [k for k, o in enumerate(s.order_by) if normal(o.text) not in outputs]
            for k in extra:
                order[k] = order[k].replace(self._text(s.order_by[k].text), f"_o{k}", 1)
            added = "".join(f", {self._text(s.order_by[k].text)} AS _o{k}" for k in extra)
            text = text.replace(f" FROM {name}", f"{added} FROM {name}", 1)
            place = f"row_number() OVER (PARTITION BY {SNAP} ORDER BY {', '.join(order) or 'struct(*)'}) AS _place"
            last = f" AND _place <= {s.offset + s.limit}" if s.limit is not None else ""
            hidden = ", ".join(["_place", *[f"_o{k}" for k in extra]])
            order = ["_place"]
            text = f"SELECT * FROM (SELECT *, {place} FROM ({text})) WHERE _place > {s.offset}{last}"
            if ordered:
                text += f" ORDER BY {SNAP}, _place"
            out = self.view.plan.base.sparkSession.sql(text).drop(*hidden.split(", "))
            return out if with_snap else out.drop(SNAP)
        if ordered:
            text += " ORDER BY " + ", ".join([SNAP, *order])
        out = self.view.plan.base.sparkSession.sql(text)
        return out if with_snap else out.drop(SNAP)

    def _default_name(self, text: str) -> str:
        return "" if len(tokenize(text)) == 1 else f" AS `{tokenize(text)[0].upper if tokenize(text)[0].kind == 'word' else text}`"

    @staticmethod
    def _aggregates(text: str) -> bool:
        tokens = tokenize(text)
        level = depths(tokens)
        for k, t in enumerate(tokens[:-1]):
            if t.upper in OUTER_AGGREGATES and tokens[k + 1].text == "(":
                end = next(j for j in range(k + 2, len(tokens)) if tokens[j].text == ")" and level[j] == level[k + 1])
                if end + 1 >= len(tokens) or tokens[end + 1].upper != "OVER":
                    return True
        return False

    def _text(self, text: str) -> str:
        """The progressive functions as columns, and windows that stay inside a snapshot."""
        tokens, out, at, k = tokenize(text), [], 0, 0
        while k < len(tokens):
            t = tokens[k]
            words = [x.upper for x in tokens[k : k + 4]]
            if t.upper in ("PROGRESSIVE_PARTITION", "PROGRESSIVE_PROGRESS") and words[1:3] == ["(", ")"]:
                whole = float(self.view.plan.steps)
                new = f"({SNAP} + 1)" if t.upper.endswith("PARTITION") else f"(cast({SNAP} + 1 AS double) / {whole}D)"
                out += [text[at : t.start], new]
                k += 3
                at = tokens[k - 1].end
                continue
            if words[:2] == ["OVER", "("]:
                by = words[2:4] == ["PARTITION", "BY"]
                last = tokens[k + 3] if by else tokens[k + 1]
                out += [text[at : last.end], f" {SNAP}," if by else f"PARTITION BY {SNAP} "]
                at = last.end
                k += 4 if by else 2
                continue
            k += 1
        return "".join([*out, text[at:]])
