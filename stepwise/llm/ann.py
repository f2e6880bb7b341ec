"""Approximate nearest neighbours with a forest of random-projection trees.

A tree splits its vectors at the median of their projections on the direction between two of them, again
and again, down to leaves of a few.  The top of the forest, one tree grown on a bounded sample, deals
the table into cells; large cells are dealt into blocks by a hash.  The vectors of a block meet in one
task, which grows the block's own trees on all of them.

A query goes down with a shared priority queue: its own path costs nothing, a wrong turn costs the
margin by which the query lies on the other side, and a leaf costs the widest margin on its way.  All
leaves of all trees of all cells that cost at most ``reach`` are opened, and never less than the query's
own leaf in each tree of its cell.  So a neighbour nearer than ``reach`` is always found.  The rows of
the opened leaves are candidates, ranked by their exact inner products.

How far to reach is measured: some of the queries are answered by brute force over the whole table, and
``reach`` is the least at which they find enough of their neighbours.

Trees that split by angle serve inner products once all vectors have one length, so vectors get one
more component that brings them to the length of the longest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width

#: Trees of a block, and vectors that one of their leaves may hold.
TREES, LEAF = 16, 64
#: Vectors that the top is grown on, and the fewest of them in a cell.
SAMPLE, CELL = 20_000, 16
#: Rows of a block: the table's by the shuffle's width, within these bounds.
LEAST_ROWS, MOST_ROWS = 4_096, 65_536
#: Recall that the trial queries must reach, less two standard errors; how many queries are tried.
RECALL, TRIALS = 0.9, 256
#: Pairs of a query and a row that are looked at at a time.
AT_ONCE = 1_000_000


@dataclass
class Forest:
    """Flat trees: children of node i are ``left[i]`` and ``right[i]``; a leaf has its number in ``leaf``."""

    normal: np.ndarray  # (nodes, dimension)
    offset: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray  # -1 for inner nodes
    roots: list[int]
    n_leaves: int

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector (rows) in each tree (columns)."""
        out = np.empty((len(vectors), len(self.roots)), dtype=np.int32)
        for t, root in enumerate(self.roots):
            stack = [(root, np.arange(len(vectors)))]
            while stack:
                node, rows = stack.pop()
                if not len(rows):
                    continue
                if self.leaf[node] >= 0:
                    out[rows, t] = self.leaf[node]
                    continue
                right = vectors[rows] @ self.normal[node] > self.offset[node]
                stack.append((self.right[node], rows[right]))
                stack.append((self.left[node], rows[~right]))
        return out

    def costs(self, queries: np.ndarray) -> np.ndarray:
        """What each leaf (rows) costs each query (columns); the own leaf of a tree costs less than nothing."""
        margins = self.normal @ queries.T - self.offset[:, None]
        cost = np.full(margins.shape, -np.inf)  # the widest margin of the wrong turns to a node
        level = np.array(self.roots)
        while len(level := level[self.leaf[level] < 0]):
            m, sofar = margins[level], cost[level]
            wrong = np.maximum(sofar, abs(m))
            cost[self.right[level]] = np.where(m > 0, sofar, wrong)
            cost[self.left[level]] = np.where(m > 0, wrong, sofar)
            level = np.concatenate([self.left[level], self.right[level]])
        ends = np.flatnonzero(self.leaf >= 0)
        return cost[ends[np.argsort(self.leaf[ends])]]


def grow(vectors: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF, seed: int = 0) -> Forest:
    """A forest on the different rows of ``vectors``."""
    vectors = np.unique(vectors, axis=0)
    random = np.random.default_rng(seed)
    normal, offset, left, right, leaf, leaves = [], [], [], [], [], 0

    def node() -> int:
        normal.append(None)
        for column, empty in ((offset, 0.0), (left, -1), (right, -1), (leaf, -1)):
            column.append(empty)
        return len(left) - 1

    roots = []
    for _ in range(trees):
        roots.append(node())
        stack = [(roots[-1], np.arange(len(vectors)))]
        while stack:
            at, rows = stack.pop()
            side = None
            if len(rows) > leaf_rows:
                for _ in range(4):  # vectors that are equal but for rounding cannot be parted
                    a, b = vectors[random.choice(rows, 2, replace=False)]
                    direction = (b - a) / (np.linalg.norm(b - a) or 1.0)
                    along = vectors[rows] @ direction
                    above = along[along > np.median(along) + 1e-9]
                    if len(above):
                        # between two values, so that rounding moves no vector across
                        cut = float(above.min() + along[along < above.min()].max()) / 2
                        side = along > cut
                        break
            if side is None:
                leaf[at], leaves = leaves, leaves + 1
                continue
            normal[at], offset[at] = direction, cut
            left[at], right[at] = node(), node()
            stack += [(left[at], rows[~side]), (right[at], rows[side])]
    none = np.zeros(vectors.shape[1])
    normals = np.array([none if n is None else n for n in normal])
    return Forest(normals, np.array(offset), np.array(left), np.array(right), np.array(leaf), roots, leaves)


def _matrix(column: pa.ListArray, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _longer(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The vectors, scaled by the longest one, with the component that makes their length one."""
    scaled = vectors / longest
    return np.column_stack([scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))])


def _asking(vectors: np.ndarray) -> np.ndarray:
    """Queries as vectors of length one, with a component more."""
    return np.column_stack([vectors / np.linalg.norm(vectors, axis=1, keepdims=True), np.zeros(len(vectors))])


@dataclass
class Block:
    """Rows that are searched together: different (id, vector) pairs and the trees grown on them."""

    ids: np.ndarray
    vectors: np.ndarray
    forest: Forest
    leaves: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray, longest: float, trees: int, seed: int) -> Block:
        order = np.lexsort((*vectors.T, ids))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (ids[1:] != ids[:-1]) | (vectors[1:] != vectors[:-1]).any(axis=1)
        ids, vectors = ids[new], vectors[new]
        longer = _longer(vectors, longest)
        forest = grow(longer, trees, LEAF, seed)
        return cls(ids, vectors, forest, forest.leaves(longer))

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query's place, row's place, score) of the ``k`` best candidates of each query, and how many candidates there were."""
        costs = self.forest.costs(_asking(queries))
        first = np.unique(self.leaves[:, 0], return_counts=True)
        least = _reach_for(costs[first[0]], first[1], k + 1)
        opened = costs <= np.maximum(reach, least)
        candidate = np.zeros((len(self.ids), len(ids)), dtype=bool)
        for t in range(self.leaves.shape[1]):
            candidate |= opened[self.leaves[:, t]]
        candidate &= self.ids[:, None] != ids[None, :]
        met = int(candidate.sum())
        if met * 8 > candidate.size:
            q, r = _best(np.where(candidate.T, queries @ self.vectors.T, -np.inf), queries, self.vectors, k)
        else:  # few candidates: only these are scored
            r, q = np.nonzero(candidate)
            order = np.argsort(q, kind="stable")
            q, r = q[order], r[order]
        score = np.empty(len(q))
        for at in range(0, len(q), 100_000):  # exactly the inner product of the two vectors, whatever was estimated above
            part = slice(at, at + 100_000)
            score[part] = (queries[q[part]] * self.vectors[r[part]]).sum(axis=1)
        order = np.lexsort((self.ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        best = np.arange(len(q)) - np.searchsorted(q, np.arange(len(ids)))[q] < k
        return q[best], r[best], score[best], met


def _reach_for(costs: np.ndarray, sizes: np.ndarray, wanted: int) -> np.ndarray:
    """How far each query (column) must reach to open leaves or cells (rows) of at least ``wanted`` rows, or all."""
    order = np.argsort(costs, axis=0, kind="stable")
    enough = np.cumsum(sizes[order], axis=0) >= min(wanted, sizes.sum())
    at = enough.argmax(axis=0)
    return np.take_along_axis(costs, np.take_along_axis(order, at[None, :], axis=0), axis=0)[0]


def _best(close: np.ndarray, queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of at least the ``k`` largest products of each query, all that come near the last one included."""
    if close.shape[1] <= k:
        return np.nonzero(np.isfinite(close))
    # the products of a matrix may differ in the last places from those of rows alone
    edge = np.partition(close, -k, axis=1)[:, -k][:, None]
    slack = 1e-9 * np.linalg.norm(queries, axis=1, keepdims=True) * np.linalg.norm(rows, axis=1).max(initial=0.0)
    return np.nonzero((close >= edge - slack) & np.isfinite(close))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    recall: float = RECALL,
    seed: int = 0,
    counted: bool = False,
) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner products with each row of ``queries``.

    Both tables have an integer id and an array of numbers.  A query doesn't find the row of its own
    id.  Returns query_id, rank (from 1), vec_id and score (in doubles), ties to the smaller id.  The
    result is approximate in that neighbours outside the opened leaves are missed; how far the search
    reaches is set so that ``TRIALS`` queries, answered by brute force, find ``recall`` of their
    neighbours less two standard errors.  The cells are fitted to the ``SAMPLE`` rows with the smallest
    id hashes; every row is in the index.  With ``counted`` there is a row for each query and block
    instead: query_id, ``met`` (candidates) and ``held`` (rows of the block).

    Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
    those of another dimension than most have; null ids take no part; rows that repeat an id and
    vector count once; a query finds all candidates if there are fewer than ``k``; empty tables give
    an empty result; other columns, whatever their names, are ignored.
    """
    spark = vectors.sparkSession
    fine = "size({v}) > 0 AND forall({v}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < {inf}) AND exists({v}, x -> x != 0)"
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
        return rows.where("id IS NOT NULL AND v IS NOT NULL").where(fine.format(v="v", inf="double('Infinity')"))

    rows, asked = clean(vectors), clean(queries)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("square")
    )
    most = sizes.orderBy(F.desc("n"), "d").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, met long, held long" if counted else "query_id long, rank int, vec_id long, score double")
    dimension, total, longest = most.d, most.n, float(np.sqrt(most.square))
    rows, asked = rows.where(F.size("v") == dimension), asked.where(F.size("v") == dimension)
    width = shuffle_width(spark)
    block_rows = max(LEAST_ROWS, min(MOST_ROWS, -(-total // width)))
    top, cells = _top(rows, total, block_rows, dimension, longest, seed)
    blocks = np.maximum(1, -(-cells // block_rows)).astype(np.int32)
    shared = spark.sparkContext.broadcast(top)  # bounded by the sample

    def place(sent: DataFrame, route: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], side: int) -> DataFrame:
        """(cell, x, side, id, v): ``route`` has the rows' places and the cells that they are sent to."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    at, cell = route(_matrix(batch.column(1), dimension))
                    sent = pa.array(at)
                    columns = [pa.array(cell.astype(np.int32)), pa.array(blocks[cell]), batch.column(0).take(sent), batch.column(1).take(sent)]
                    yield pa.RecordBatch.from_arrays(columns, names=["cell", "p", "id", "v"])

        found = sent.mapInArrow(run, f"cell int, p int, id long, v {kind}")
        own = F.pmod(F.xxhash64("id"), F.col("p")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("p") - 1))
        return found.select("cell", (every if side else own).alias("x"), F.lit(side).alias("side"), "id", "v")

    def home(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(vectors)), shared.value.leaves(_longer(vectors, longest))[:, 0]

    unit = ["cell", "x"]
    placed = place(rows, home, 0)
    reach = _reach(shared, blocks, placed, asked, k, dimension, longest, trees, recall, seed)

    def visited(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        costs = shared.value.costs(_asking(vectors))
        cell, at = np.nonzero(costs <= np.maximum(reach, _reach_for(costs, cells, k + 1)))
        return at, cell

    met = placed.unionByName(place(asked, visited, 1)).repartition(width, *unit).sortWithinPartitions(*unit, "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in _blocks(batches, dimension, longest, trees, seed):
            for at, n_at_once in _steps(part.num_rows, len(block.ids)):
                some = part.slice(at, n_at_once)
                ids = some.column(3).to_numpy()
                q, r, score, n = block.search(ids, _matrix(some.column(4), dimension), k, reach)
                if counted:
                    each = [pa.array(c) for c in (ids, np.full(len(ids), n / len(ids)).round().astype(np.int64), np.full(len(ids), len(block.ids)))]
                    yield pa.RecordBatch.from_arrays(each, names=["query_id", "met", "held"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(block.ids[r]), pa.array(score)], names=["query_id", "vec_id", "score"])

    if counted:
        return met.mapInArrow(search, "query_id long, met long, held long")
    found = met.mapInArrow(search, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _top(rows: DataFrame, total: int, block_rows: int, dimension: int, longest: float, seed: int) -> tuple[Forest, np.ndarray]:
    """The tree whose leaves are the cells, and the rows of each cell."""
    if total <= block_rows:
        return grow(np.zeros((1, dimension + 1)), 1), np.array([total])
    mark = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2**32))
    bound = int(2**32 * min(1.0, SAMPLE / total))
    drawn = rows.where(mark < bound).orderBy(mark).limit(SAMPLE).select("v").toArrow()
    sample = _matrix(drawn.column("v").combine_chunks(), dimension) if drawn.num_rows else np.ones((1, dimension))
    top = grow(_longer(sample, longest), 1, max(CELL, len(sample) * block_rows // total), seed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(top.n_leaves, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                sums += np.bincount(top.leaves(_longer(_matrix(batch.column(1), dimension), longest))[:, 0], minlength=len(sums))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["cell", "n"])

    counted = rows.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    sums = {r.cell: r.n for r in counted.collect()}  # a row for each cell
    return top, np.array([sums.get(c, 0) for c in range(top.n_leaves)])


def _blocks(batches: Iterator[pa.RecordBatch], dimension: int, longest: float, trees: int, seed: int) -> Iterator[tuple[Block, pa.RecordBatch]]:
    """(block, queries), batch by batch, from rows sorted by (cell, x, side); a block's rows come before its queries."""
    now, held, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        code = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
        edges = [0, *(np.flatnonzero((code[1:] != code[:-1]).any(axis=1)) + 1).tolist(), len(code)]
        for a, b in zip(edges, edges[1:], strict=False):
            if tuple(code[a, :2]) != now:
                now, held, block = tuple(code[a, :2]), [], None
            part = batch.slice(a, b - a)
            if not code[a, 2]:
                held.append((part.column(3).to_numpy(), _matrix(part.column(4), dimension)))
                continue
            if block is None and held:
                block = Block.of(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), longest, trees, seed)
                held = []
            if block is not None:
                yield block, part


def _steps(queries: int, rows: int) -> Iterator[tuple[int, int]]:
    """(begin, length) of the queries that meet so many rows at a time."""
    some = max(1, AT_ONCE // max(1, rows))
    for at in range(0, queries, some):
        yield at, min(some, queries - at)


def _reach(shared, blocks: np.ndarray, placed: DataFrame, asked: DataFrame, k: int, dimension: int, longest: float, trees: int, wanted: float, seed: int) -> float:  # noqa: ANN001
    """The least reach at which queries find ``wanted`` of their neighbours.

    The trial queries, of different vectors, meet every row; a neighbour is found from the reach on that
    opens its cell and the cheapest of its leaves.
    """
    trials = max(16, min(TRIALS, 20_000 // k))
    chosen = asked.groupBy("v").agg(F.min("id").alias("id")).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(trials).collect()
    if not chosen:
        return 0.0
    queries, ids = np.array([r.v for r in chosen], dtype=np.float64), np.array([r.id for r in chosen])
    to_cell = shared.value.costs(_asking(queries))
    # the same queries, at the end of each block
    few = placed.sparkSession.createDataFrame([(c, x) for c, n in enumerate(blocks.tolist()) for x in range(n)], "cell int, x int")
    marks = few.select("cell", "x", F.lit(1).alias("side"), F.lit(0).cast("long").alias("id"), F.array().cast(placed.schema["v"].dataType).alias("v"))
    met = placed.unionByName(marks).repartition(shuffle_width(placed.sparkSession), "cell", "x").sortWithinPartitions("cell", "x", "side")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in _blocks(batches, dimension, longest, trees, seed):
            for at, some in _steps(len(queries), len(block.ids)):
                asking = queries[at : at + some]
                close = asking @ block.vectors.T
                close[ids[at : at + some, None] == block.ids[None, :]] = -np.inf
                q, r = _best(close, asking, block.vectors, k)
                score = (asking[q] * block.vectors[r]).sum(axis=1)
                cost = block.forest.costs(_asking(asking))[block.leaves[r], q[:, None]].min(axis=1)
                cost = np.maximum(cost, to_cell[part.column(0)[0].as_py()][at + q])
                columns = [(at + q).astype(np.int32), block.ids[r], score, cost]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "id", "score", "cost"])

    best = met.mapInArrow(meet, "q int, id long, score double, cost double").groupBy("q", "id").agg(F.max_by("cost", "score").alias("cost"), F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "cost").toPandas()
    if not len(best):
        return 0.0
    q, cost = best["q"].to_numpy(), np.maximum(best["cost"].to_numpy(), 0.0)
    counts = np.bincount(q, minlength=len(queries))
    # the recall grows with the reach: the least one that suffices is among the costs
    ladder, low, high = np.unique(cost), 0, len(np.unique(cost)) - 1
    while low < high:
        at = (low + high) // 2
        recall = (np.bincount(q, cost <= ladder[at], minlength=len(queries)) / np.maximum(counts, 1))[counts > 0]
        if recall.mean() - 2 * recall.std() / len(recall) ** 0.5 >= wanted:
            high = at
        else:
            low = at + 1
    return float(ladder[low]) * (1 + 1e-9) + 1e-12  # a margin may differ in its last places from block to block

