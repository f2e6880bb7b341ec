"""Mixing sources to target weights over a domain-language-source tree (DataFrame functions only).

The tokens available under every node are summed once.  A budget goes down the tree level by level:
the children of a node share its budget by weight, no child takes more than its subtree holds, and
what a full child leaves goes to its siblings.  As a node never asks for more than its own subtree
holds, a shortage reaches the siblings of an ancestor only when all nearer siblings are full.  A
leaf whose budget exceeds its tokens runs through whole epochs, and the last, partial one takes a
prefix of the documents in an order seeded for that leaf's epoch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: A table of leaves with at most so many rows is broadcast.
BROADCAST_LEAVES = 20_000
#: Most hexadecimal digits of the order key that number the pieces in which a leaf is summed.  A leaf of n rows
#: has about sqrt(n) pieces of sqrt(n) rows, within a factor of four.
MOST_DIGITS = 10


def _share(nodes: DataFrame, parent: Sequence[str], child: str) -> DataFrame:
    """Divide the column ``budget`` among the children of each parent; adds ``alloc``.

    The children are taken in the order in which they fill up (capacity by weight).  A child is full
    if the budget reaches the level at which it fills; the others share the rest by weight.  Children
    without weight get nothing.
    """
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    upto = group.orderBy("ratio", F.col(child)).rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.where(F.col("w") > 0).withColumn("ratio", F.col("cap") / F.col("w"))
    nodes = nodes.select(
        "*", F.sum("cap").over(upto).alias("cc"), F.sum("w").over(upto).alias("cw"), F.sum("w").over(group).alias("tw")
    )
    full = F.col("cc") + F.col("ratio") * (F.col("tw") - F.col("cw")) <= F.col("budget")
    nodes = nodes.withColumn("full", full)
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(group)
    left = F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("w"))).over(group)
    nodes = nodes.select("*", taken.alias("fc"), left.alias("fw"))
    rest = F.when(F.col("fw") > 0, F.col("w") * (F.col("budget") - F.col("fc")) / F.col("fw")).otherwise(F.lit(0.0))
    return nodes.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(rest))


def _sized(leaves: DataFrame) -> DataFrame:
    """Mark a checkpointed table of leaves for broadcast if its counted rows are few."""
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Sequence[Column], budget: tuple[int, int], max_epochs: int
) -> DataFrame:
    """Budgets of the leaves in tokens.

    ``leaves`` has the ``levels`` and ``supply``; ``weights`` has an expression for each level.
    ``budget`` is a fraction (numerator, denominator) of all tokens.  Returns the levels, ``supply``
    and ``budget`` (long).
    """
    levels = list(levels)
    sized = leaves.withColumn("cap", (F.col("supply") * max_epochs).cast("double"))
    whole = Window.partitionBy(F.lit(0))
    above: DataFrame | None = None
    for depth, (level, weight) in enumerate(zip(levels, weights, strict=True)):
        keys = levels[: depth + 1]
        nodes = sized.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
        nodes = nodes.withColumn("w", weight.cast("double"))
        if above is None:
            asked = F.floor(F.sum("supply").over(whole) * budget[0] / budget[1]).cast("double")
            nodes = nodes.withColumn("budget", F.least(asked, F.sum("cap").over(whole)))
        else:
            nodes = nodes.join(above, keys[:-1])
        above = _share(nodes, keys[:-1], level).select(*keys, F.col("alloc").alias("budget"), "supply")
        if depth < len(levels) - 1:
            above = above.drop("supply")
    return above.withColumn("budget", F.floor("budget").cast("long"))


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: Sequence[Column],
    budget: tuple[int, int] = (1, 2),
    max_epochs: int = 1,
    seed: int = 0,
    id_col: str = "doc_id",
    tokens: Column | None = None,
) -> DataFrame:
    """Choose the documents of a mix.

    Returns the rows of ``docs`` that are taken at least once, all columns, and ``mix_<level>`` for
    each of the ``levels`` (a name and its expression, from the root down), ``mix_tokens``,
    ``mix_budget`` (of the leaf) and ``copies``, the number of times the row is taken.

    ``tokens``: tokens of a row; by default a quarter of the text's UTF-8 bytes, rounded up.  A tokenizer's
    counts are used by counting first, into a column of ``docs`` (``tokens=F.col("n_tokens")``).
    Texts don't move between machines unless there are more than ``BROADCAST_LEAVES`` leaves; the
    leaves are counted first, and more of them are joined by a shuffle.

    Cases: a null level is the level ``''``; a null text has no tokens; rows without tokens are taken
    with the prefix they stand in; rows with one id are taken or left together; columns of ``docs``
    whose names clash with the added ones are replaced; an empty table gives an empty result.
    """
    if tokens is None:
        tokens = F.expr("(coalesce(octet_length(text), 0) + 3) div 4")
    names = [f"mix_{k}" for k in levels]
    added = [*names, "mix_tokens", "mix_budget", "copies"]
    kept = [c for c in docs.columns if c.lower() not in [a.lower() for a in added]]
    rows = docs.select(
        *kept,
        *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values(), strict=True)],
        tokens.cast("long").alias("mix_tokens"),
    )
    narrow = rows.select(F.col(id_col).alias("_id"), *names, "mix_tokens")
    leaves = checkpoint(narrow.groupBy(*names).agg(F.sum("mix_tokens").alias("supply"), F.count(F.lit(1)).alias("mix_rows")))
    plan = leaf_budgets(leaves.drop("mix_rows"), names, weights, budget, max_epochs).where("budget > 0").select(
        *names,
        F.col("budget").alias("mix_budget"),
        F.expr("budget div supply").alias("whole"),
        (F.col("budget") % F.col("supply")).alias("rest"),
    )
    digits = F.least(F.lit(MOST_DIGITS), F.greatest(F.lit(1), F.round(F.log(F.col("mix_rows").cast("double")) / math.log(256)))).cast("int")
    plan = checkpoint(plan.join(leaves.select(*names, digits.alias("digits")), names))
    key = lambda i: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), i.cast("string")))
    # The prefix: pieces of a leaf by the first digits of the key, then rows of the piece where the budget ends.
    keyed = narrow.join(_sized(plan), names).select(*names, "rest", "mix_tokens", "digits", key(F.col("_id")).alias("k"))
    keyed = keyed.withColumn("piece", F.expr("substring(k, 1, digits)")).drop("digits")
    pieces = keyed.groupBy(*names, "rest", "piece").agg(F.sum("mix_tokens").alias("n"))
    upto = Window.partitionBy(*names).orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("upto", F.sum("n").over(upto))
    last = pieces.where("upto > rest").groupBy(*names).agg(
        F.min("piece").alias("piece"), F.min(F.col("upto") - F.col("n")).alias("before")
    )
    in_piece = Window.partitionBy(*names).orderBy("k").rangeBetween(Window.unboundedPreceding, 0)
    edge = (
        keyed.join(last, [*names, "piece"])
        .withColumn("sum", F.col("before") + F.sum("mix_tokens").over(in_piece))
        .where("sum <= rest")
        .groupBy(*names)
        .agg(F.max("k").alias("edge_key"))
    )
    # Every leaf has a rest below its supply, so its budget ends in one of its pieces.
    cuts = plan.join(last.select(*names, "piece"), names, "left").join(edge, names, "left").select(
        *names, "mix_budget", "whole", F.coalesce("edge_key", F.col("piece"), F.lit("")).alias("cut")
    )
    taken = (key(F.col(id_col)) <= F.col("cut")).cast("int")
    return (
        rows.join(_sized(checkpoint(cuts)), names)
        .withColumn("copies", (F.col("whole") + F.coalesce(taken, F.lit(0))).cast("int"))
        .where("copies > 0")
        .select(*kept, *added)
    )
