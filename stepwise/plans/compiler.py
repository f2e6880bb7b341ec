"""From a parsed select to DataFrames: classification of items, partial states, read-out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ProgressiveError
from ..functions.readout import average, half_width, scaled
from ..operators.snapshots import SNAP, STEP, State, all_snapshots, grouping_sets, merge_states, top_per_snapshot
from ..sources.catalog import Catalog
from . import futures
from .lexer import Token, depths, span, tokenize
from .statements import Order, Select

AGGREGATES = ("SUM", "COUNT", "AVG", "MIN", "MAX", "APPROX_COUNT_DISTINCT", "PROGRESSIVE_CONFIDENCE")
META = ("PROGRESSIVE_PARTITION", "PROGRESSIVE_PROGRESS")
#: Flags of FUTURE predicates in one column.
FLAG_BITS = 62


def normal(text: str) -> str:
    """Text of an expression without regard to case, spaces, quotes of names and table qualifiers."""
    out: list[str] = []
    for t in tokenize(text):
        if t.text == "." and out and out[-1].isidentifier():
            out.pop()
            continue
        out.append(t.name.lower() if t.kind in ("word", "quoted") else t.text)
    return " ".join(out)


def call(text: str) -> tuple[str, str] | None:
    """(NAME, argument) if the text is a call of one of our functions."""
    tokens = tokenize(text)
    if len(tokens) < 3 or tokens[0].kind != "word" or tokens[1].text != "(" or tokens[-1].text != ")":
        return None
    if tokens[0].upper not in AGGREGATES + META or any(d == 0 for d in depths(tokens)[2:-1]):
        return None
    return tokens[0].upper, span(text, tokens[2:-1])


def is_literal(text: str) -> bool:
    tokens = tokenize(text)
    tokens = tokens[1:] if tokens and tokens[0].text in "+-" else tokens
    return len(tokens) == 1 and (tokens[0].kind in ("number", "string") or tokens[0].upper in ("NULL", "TRUE", "FALSE"))


def output_name(text: str, alias: str | None) -> str:
    if alias:
        return alias
    tokens = tokenize(text)
    if tokens[0].kind == "word" and len(tokens) > 1 and tokens[1].text == "(":
        return tokens[0].upper
    return tokens[-1].name


@dataclass
class Item:
    """A compiled select item.  ``kind``: key, future, literal, or the name of a function."""

    kind: str
    name: str
    argument: str = ""
    key: str = ""


@dataclass
class Plan:
    """A compiled progressive select or view definition."""

    select: Select
    catalog: Catalog
    tables: list[str]
    rows: Callable[[int | None], DataFrame]  # joined and filtered, with _step: those of a step, or all
    steps: int
    items: list[Item] = field(default_factory=list)
    keys: dict[str, str] = field(default_factory=dict)  # column -> expression
    future_keys: dict[str, str] = field(default_factory=dict)
    tree: futures.Node | None = None
    flag_of: dict[int, str] = field(default_factory=dict)  # identity of a node -> expression, 0 or 1
    states: dict[tuple[str, str], State] = field(default_factory=dict)
    hidden: list[Item] = field(default_factory=list)

    @property
    def base(self) -> DataFrame:
        """The rows of all steps."""
        return self.rows(None)

    @property
    def flag_words(self) -> list[str]:
        """The columns that hold the flags, ``FLAG_BITS`` in each."""
        return [f"_f{k}" for k in range(-(-len(self.flag_of) // FLAG_BITS))]

    @property
    def aggregating(self) -> bool:
        return bool(self.states) or any(i.kind in META for i in self.items)

    def state(self, kind: str, argument: str) -> State:
        at = kind, normal(argument)
        if at not in self.states:
            self.states[at] = State(f"_s{len(self.states)}", kind, argument)
        return self.states[at]

    # --- partial states

    def partial(self, base: DataFrame | None = None, guard: Column | None = None, *more: Column) -> DataFrame:
        """(_step, keys, future keys, flags, states): one row for each group and step.

        With ``guard``, a named condition that is never null, the rows that it excludes are one group a
        step, whose states mean nothing; the condition and the aggregates ``more`` are columns, too.
        """
        base = self.base if base is None else base
        nodes = futures.flags(self.tree)
        keys = [(c, F.expr(e)) for c, e in {**self.keys, **self.future_keys}.items()]
        for k, word in enumerate(self.flag_words):
            bits = [f"shiftleft(CAST(coalesce({futures.to_sql(n)}, false) AS BIGINT), {b})" for b, n in enumerate(nodes[k * FLAG_BITS : (k + 1) * FLAG_BITS])]
            keys.append((word, F.expr(" | ".join(bits))))
        if guard is not None:
            keys = [(c, F.when(guard, e)) for c, e in keys]
        grouped = base.groupBy(F.col(STEP), *[e.alias(c) for c, e in keys], *([] if guard is None else [guard]))
        aggregates = [*[s.partial() for s in self.states.values()], *more]
        return grouped.agg(*aggregates) if aggregates else grouped.agg(F.lit(1).alias("_any")).drop("_any")

    def reduced(self, partial: DataFrame, condition: str | None, active: Sequence[str], with_step: bool = True) -> DataFrame:
        """The partial states of a reader: flags applied, inactive future keys merged away."""
        if condition:
            partial = partial.where(condition)
        keys = [*self.keys, *active]
        if self.select.grouping:
            partial = grouping_sets(partial, list(self.keys), self.select.grouping, self.select.grouping_sets)
            keys.append("_grouping")
        return merge_states(partial, [STEP, *keys] if with_step else keys, list(self.states.values()))

    def group_columns(self, active: Sequence[str] = ()) -> list[str]:
        return [*self.keys, *active, *(["_grouping"] if self.select.grouping else [])]

    def snapshots(self, partial: DataFrame, condition: str | None = None, active: Sequence[str] = ()) -> DataFrame:
        """All snapshots, read out (``_snap``, then ``_i<n>`` for each item)."""
        reduced = self.reduced(partial, condition, active)
        return self.read_out(all_snapshots(reduced, self.group_columns(active), list(self.states.values()), self.steps), active)

    # --- read-out

    def value(self, item: Item) -> Column:
        progress = (F.col(SNAP) + 1).cast("double") / F.lit(float(self.steps))
        if item.kind in ("key", "future"):
            return F.col(item.key)
        if item.kind == "literal":
            return F.expr(item.argument)
        if item.kind == "PROGRESSIVE_PARTITION":
            return (F.col(SNAP) + 1).cast("int")
        if item.kind == "PROGRESSIVE_PROGRESS":
            return progress
        if item.kind == "AVG":
            return average(F.col(self.state("sum", item.argument).name), F.col(self.state("count", item.argument).name))
        if item.kind in ("SUM", "COUNT"):
            return scaled(F.col(self.state(item.kind.lower(), item.argument).name), progress)
        if item.kind in ("MIN", "MAX"):
            return F.col(self.state(item.kind.lower(), item.argument).name)
        if item.kind == "APPROX_COUNT_DISTINCT":  # of what has been seen: it does not grow with the progress
            return F.coalesce(F.hll_sketch_estimate(self.state("distinct", item.argument).name), F.lit(0))
        bounds = self.catalog.bounds(item.argument, self.tables)
        return half_width(bounds.min, bounds.max, F.col(self.state("count", item.argument).name))

    def read_out(self, states: DataFrame, active: Sequence[str] = ()) -> DataFrame:
        shown = [i for i in self.items if i.kind != "future" or i.key in active]
        columns = [self.value(i).alias(f"_i{k}") for k, i in enumerate(shown)]
        columns += [self.value(i).alias(f"_h{k}") for k, i in enumerate(self.hidden)]
        return states.select(SNAP, *self.group_columns(active), *columns)

    def finish(self, read: DataFrame, active: Sequence[str] = (), ordered: bool = True, with_snap: bool = False) -> DataFrame:
        """HAVING, order and limit on each snapshot, then the columns under their names."""
        s = self.select
        if s.having:
            read = read.where(self.rewrite(s.having))
        order = [self._order(o) for o in s.order_by]
        read = top_per_snapshot(read, order, s.limit, s.offset)
        if ordered and order:
            read = read.orderBy(SNAP, *order)
        shown = [i for i in self.items if i.kind != "future" or i.key in active]
        names = [SNAP] if with_snap else []
        return read.select(*names, *[F.col(f"_i{k}").alias(i.name) for k, i in enumerate(shown)])

    def _order(self, order: Order) -> Column:
        c = F.expr(self.rewrite(order.text))
        last = order.nulls == "LAST"
        if order.descending:
            return c.desc_nulls_first() if order.nulls == "FIRST" else c.desc_nulls_last()
        return c.asc_nulls_last() if last else c.asc_nulls_first()

    def rewrite(self, text: str) -> str:
        """An expression over the select's items, keys and aggregates as one over the columns read out."""
        whole = normal(text)
        for k, i in enumerate(self.items):
            if whole == i.name.lower() or (i.argument and i.kind not in ("key", "future") and whole == normal(f"{i.kind}({i.argument})")):
                return f"_i{k}"
        for column, expression in {**self.keys, **self.future_keys}.items():
            if whole == normal(expression):
                return column
        if whole.isdigit() and 1 <= int(whole) <= len(self.items):
            return f"_i{int(whole) - 1}"
        tokens, out, at, k = tokenize(text), [], 0, 0
        while k < len(tokens):
            t, end = tokens[k], k
            new = None
            if t.kind == "word" and t.upper in AGGREGATES + META and k + 1 < len(tokens) and tokens[k + 1].text == "(":
                level = depths(tokens)
                end = next(j for j in range(k + 2, len(tokens)) if tokens[j].text == ")" and level[j] == level[k + 1])
                new = self._hidden(span(text, tokens[k : end + 1]))
            elif t.kind in ("word", "quoted"):
                while end + 2 < len(tokens) and tokens[end + 1].text == ".":
                    end += 2
                new = self._column(span(text, tokens[k : end + 1]))
            if new:
                out += [text[at : t.start], new]
                at = tokens[end].end
            k = end + 1
        return "".join([*out, text[at:]])

    def _column(self, text: str) -> str | None:
        name = normal(text)
        for k, i in enumerate(self.items):
            if i.name.lower() == name:
                return f"_i{k}"
        return next((c for c, e in {**self.keys, **self.future_keys}.items() if normal(e) == name), None)

    def _hidden(self, text: str) -> str:
        kind, argument = call(text) or ("", "")
        for prefix, items in (("_i", self.items), ("_h", self.hidden)):
            for k, i in enumerate(items):
                if i.kind == kind and normal(i.argument or "*") == normal(argument or "*"):
                    return f"{prefix}{k}"
        self.hidden.append(Item(kind, text, argument))
        self._declare(self.hidden[-1])
        return f"_h{len(self.hidden) - 1}"

    def _declare(self, item: Item) -> None:
        """Make sure that the states that ``item`` is read from are gathered."""
        if item.kind in AGGREGATES and normal(item.argument).startswith("distinct "):
            raise ProgressiveError(f"{item.kind}(DISTINCT) cannot be merged over partitions; approx_count_distinct can")
        if item.kind == "AVG":
            self.state("sum", item.argument)
        if item.kind in ("AVG", "PROGRESSIVE_CONFIDENCE"):
            self.state("count", item.argument)
        if item.kind == "PROGRESSIVE_CONFIDENCE":
            self.catalog.bounds(item.argument, self.tables)
        if item.kind in ("SUM", "COUNT", "MIN", "MAX"):
            self.state(item.kind.lower(), item.argument)
        if item.kind == "APPROX_COUNT_DISTINCT":
            self.state("distinct", item.argument)


def _window_or_nested(tokens: list[Token]) -> None:
    if any(t.upper == "OVER" for t in tokens):
        raise ProgressiveError("window functions can be used on the reading of a view only")


def compile_select(select: Select, catalog: Catalog, tables: list[str], joined: Callable[[int | None], DataFrame], steps: int, in_view: bool) -> Plan:
    """Compile ``select`` over ``joined`` (the joined tables of a step or of all, with ``_step``, not yet filtered)."""
    tree = futures.parse_where(select.where) if in_view else None
    if not in_view and select.where and isinstance(futures.parse_where(select.where), futures.Future | futures.Both | futures.Either):
        raise ProgressiveError("FUTURE belongs into the definition of a view")
    condition = futures.source_filter(tree) if in_view else select.where
    plan = Plan(select, catalog, tables, lambda step: joined(step).where(condition) if condition else joined(step), steps, tree=tree)
    for k, node in enumerate(futures.flags(tree)):
        plan.flag_of[id(node)] = f"(shiftright(_f{k // FLAG_BITS}, {k % FLAG_BITS}) & 1)"
    aliases = {i.alias.lower(): i.text for i in select.items if i.alias}
    for g in select.group_by:
        text = select.items[int(g.text) - 1].text if g.text.isdigit() and int(g.text) <= len(select.items) else aliases.get(normal(g.text), g.text)
        into = plan.future_keys if g.future else plan.keys
        into[f"_{'g' if g.future else 'k'}{len(into)}"] = text
    calls = [call(i.text) for i in select.items]
    plain = not any(c for c in calls) and not select.group_by
    for item, called in zip(select.items, calls, strict=True):
        _window_or_nested(tokenize(item.text))
        name = output_name(item.text, item.alias)
        if called:
            if item.future:
                raise ProgressiveError("an aggregate cannot be FUTURE")
            if called[0] in META and called[1]:
                raise ProgressiveError(f"{called[0]} takes no argument")
            if called[0] not in META and not called[1]:
                raise ProgressiveError(f"{called[0]} needs an argument")
            new = Item(called[0], name, called[1])
            plan._declare(new)
        elif is_literal(item.text):
            if not item.alias:
                raise ProgressiveError("a constant needs an alias")
            new = Item("literal", name, item.text)
        elif item.text == "*":
            raise ProgressiveError("* can be selected from a view only")
        else:
            wanted = normal(item.text)
            keys = {**plan.keys, **plan.future_keys}
            key = next((c for c, e in keys.items() if normal(e) == wanted), None)
            if key is None and plain:
                key = f"_k{len(plan.keys)}"
                plan.keys[key] = item.text
            if key is None:
                raise ProgressiveError(f"{item.text} is neither an aggregate nor in GROUP BY")
            if item.future != (key in plan.future_keys):
                raise ProgressiveError(f"{item.text} must be FUTURE both in the list and in GROUP BY, or in neither")
            new = Item("future" if item.future else "key", name, key=key)
        plan.items.append(new)
    # aggregates that only HAVING and ORDER BY name have states of their own
    for text in [select.having or "", *[o.text for o in select.order_by]]:
        if text:
            plan.rewrite(text)
    return plan
