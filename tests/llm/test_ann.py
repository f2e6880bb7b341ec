import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from stepwise.llm.ann import Block, Forest, grow, nearest


def exact(vectors, queries, k):
    """[(query, rank, id)] by inner product, ties to the smaller id."""
    out = []
    for q, x in queries:
        scored = sorted((-float(np.dot(np.float64(x), np.float64(v))), d) for d, v in vectors if d != q)
        out += [(q, n + 1, d) for n, (_, d) in enumerate(scored[:k])]
    return out


def test_small_tables_are_exact(tables):
    r = np.random.default_rng(1)
    good = [(k, r.normal(size=4).tolist()) for k in range(60)] + [(k, [1.0, 2.0, 0.5, 0.0]) for k in range(60, 90)]
    odd = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 2.0, 3.0]), (203, [float("nan"), 1.0, 1.0, 1.0]), (204, [float("inf"), 0.0, 0.0, 0.0]), (205, [1.0, 2.0]), (206, []), (None, [1.0] * 4), (5, good[5][1])]
    table = tables([(*x, 1) for x in good + odd], "vec_id long, embedding array<double>, leaf int")
    got = nearest(table, table.where("vec_id % 20 = 0"), k=7).collect()
    assert sorted((x.query_id, x.rank, x.vec_id) for x in got) == sorted(exact(good, [x for x in good if x[0] % 20 == 0], 7))
    by = dict(good)
    assert all(abs(x.score - np.dot(by[x.query_id], by[x.vec_id])) < 1e-12 for x in got)


def test_fewer_rows_than_asked_for_and_none(tables):
    table = tables([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = sorted((x.query_id, x.rank, x.vec_id) for x in nearest(table, table.where("vec_id = 0"), k=20).collect())
    assert got == [(0, 1, 2), (0, 2, 1)]
    assert nearest(table.limit(0), table, k=3).collect() == []
    assert nearest(table, table.limit(0), k=3).collect() == []


def test_cells_and_blocks_of_a_hot_vector(tables, monkeypatch):
    for name, value in (("LEAST_ROWS", 32), ("MOST_ROWS", 32), ("CELL", 4), ("LEAF", 4), ("AT_ONCE", 200)):
        monkeypatch.setattr(f"stepwise.llm.ann.{name}", value)
    r = np.random.default_rng(2)
    rows = [(k, [1.0, 1.0, 0.0] if k % 3 == 0 else r.normal(size=3).tolist()) for k in range(300)]
    table = tables(rows, "vec_id long, embedding array<double>")
    queries = [x for x in rows if x[0] % 20 == 0]
    # with recall 1 the reach opens whatever holds a neighbour of the queries, all of which are tried
    got = nearest(table, table.where("vec_id % 20 = 0"), k=5, recall=1.0).collect()
    assert sorted((x.query_id, x.rank, x.vec_id) for x in got) == sorted(exact(rows, queries, 5))
    # of cells that hold too few rows, more are visited
    got = nearest(table, table.where("vec_id % 20 = 0"), k=250, recall=0.0).collect()
    assert len(got) == 250 * len(queries)


def test_forest():
    r = np.random.default_rng(3)
    sample = r.normal(size=(2000, 8))
    forest = grow(sample, trees=5, leaf_rows=30, seed=1)
    assert isinstance(forest, Forest) and len(forest.roots) == 5
    leaves = forest.leaves(sample)
    counts = np.bincount(leaves.ravel(), minlength=forest.n_leaves)
    assert counts.sum() == 5 * 2000 and counts.min() >= 1 and counts.max() <= 30
    costs = forest.costs(sample[:50])
    assert costs.shape == (forest.n_leaves, 50)
    own = np.zeros(costs.shape, dtype=bool)
    own[leaves[:50].T, np.arange(50)] = True
    assert ((costs == -np.inf) == own).all()
    # a vector that is nearer than a leaf's cost does not lie in that leaf
    near = sample[:50] + 0.05 * r.normal(size=(50, 8))
    at = forest.leaves(near)
    for k in range(50):
        assert (costs[at[k], k] <= np.linalg.norm(near[k] - sample[k]) + 1e-9).all()
    assert grow(np.ones((100, 3)), trees=2).n_leaves == 2  # equal vectors cannot be split


def test_a_block_finds_what_it_promises():
    r = np.random.default_rng(6)
    ids, vectors = np.arange(500), r.normal(size=(500, 6))
    block = Block.of(np.concatenate([ids, ids]), np.concatenate([vectors, vectors]), float(np.linalg.norm(vectors, axis=1).max()), 4, 0)
    assert len(block.ids) == 500
    whole = exact(list(zip(ids.tolist(), vectors.tolist(), strict=True)), list(zip(range(40), vectors[:40].tolist(), strict=True)), 10)
    for reach in (0.0, 0.3, 9.0):
        q, rows, score, met = block.search(ids[:40], vectors[:40], 10, reach)
        assert (np.bincount(q) == 10).all() and (met == 40 * 499) == (reach == 9.0)
        assert np.allclose(score, (vectors[q] * block.vectors[rows]).sum(axis=1), atol=0)
    assert [(int(a), int(block.ids[b])) for a, b in zip(q, rows, strict=True)] == [(a, c) for a, _, c in whole]


def test_recall_of_the_query(spark):
    from stepwise.llm.queries import op1_ann

    sf_dir = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, matrix = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = {}
    for r in op1_ann(spark, sf_dir).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for k in np.flatnonzero(ids % 20 == 0):
        scores = matrix @ matrix[k]
        scores[k] = -np.inf
        recall.append(len(got[ids[k]] & set(ids[np.argsort(-scores)[:20]])) / 20)
    assert np.mean(recall) >= 0.9


def recall_of(got, rows, queries, k):
    """The part of the true neighbours that ``got`` has, for each query."""
    found = {(r.query_id, r.vec_id) for r in got}
    want = exact(rows, queries, k)
    return [np.mean([(q, d) in found for p, _, d in want if p == q]) for q in (q for q, _ in queries)]


def stored(path, matrix):
    """A table of vectors, written as Parquet."""
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(matrix.astype(np.float32).ravel()), matrix.shape[1]).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(len(matrix)), "embedding": vectors}), path, row_group_size=20_000)


@pytest.mark.parametrize("n, kind", [(50_000, "table"), (200_000, "table"), (50_000, "gauss")])
def test_recall_where_the_table_is_not_searched_whole(spark, tmp_path, monkeypatch, n, kind):
    """Rows like those of sf0.1 with noise, and rows without any structure; blocks as on a wide cluster."""
    monkeypatch.setattr("stepwise.llm.ann.shuffle_width", lambda spark: 12)
    r = np.random.default_rng(7)
    if kind == "table":
        near = np.array([x.embedding for x in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()])
        matrix = near[r.integers(0, len(near), n)] + near.std() * 0.5 * r.normal(size=(n, near.shape[1]))
    else:
        matrix = r.normal(size=(n, 64))
    stored(str(tmp_path / "v.parquet"), matrix)
    table = spark.read.parquet(str(tmp_path / "v.parquet"))
    queries = table.where(f"vec_id % {n // 150} = 0")
    got = {}
    for x in nearest(table, queries).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    matrix = matrix.astype(np.float32).astype(np.float64)
    recall = []
    for q in range(0, n, n // 150):
        scores = matrix @ matrix[q]
        scores[q] = -np.inf
        recall.append(len(got[q] & set(np.argpartition(-scores, 20)[:20].tolist())) / 20)
    part = nearest(table, queries, counted=True).groupBy("query_id").sum("met").toPandas()["sum(met)"].mean() / n
    print(f"{kind}, {n} rows: recall {np.mean(recall):.3f}, candidates {part:.3f} of the rows")
    assert np.mean(recall) >= 0.9 and part < (0.9 if kind == "gauss" else 0.7)


def test_copies_do_not_hide_other_rows(tables):
    r = np.random.default_rng(5)
    rows = [(k, ([1.0] * 16 if k % 3 == 0 else r.normal(size=16).tolist())) for k in range(4000)]
    table = tables(rows, "vec_id long, embedding array<double>")
    queries = [x for x in rows if x[0] % 100 == 1 and x[0] % 3]
    got = {(x.query_id, x.vec_id) for x in nearest(table, table.where("vec_id % 100 IN (0, 1)"), k=10).collect()}
    # the hot vector is a third of the rows, and of the queries
    want = exact(rows, queries, 10)
    recall = sorted(np.mean([(q, d) in got for p, _, d in want if p == q]) for q, _ in queries)
    assert np.mean(recall) >= 0.9 and np.mean(recall[: len(recall) // 10 + 1]) >= 0.7
