import random
import re

import numpy as np
import pyarrow as pa
import pytest

from stepwise.llm.graph import connected_components
from stepwise.llm.ngram_join import similar_groups, sketch
from stepwise.llm.partenum import instances, signatures
from stepwise.llm.shingles import shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text, n):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(texts, n, num, den):
    """{id: (size, smallest id of the group)}"""
    sets = {d: words_of(t, n) for d, t in texts}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and both and both * den >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def corpus(seed, families=12, size=9):
    """Families of near copies around the threshold, exact copies, and odd texts."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = [None, "", "  \n ", "one", "ONE", "two words", "Two\twords", "été Été", "a\x0bb c d"]
    for f in range(families):
        base = [r.choice(vocabulary) for _ in range(r.choice([4, 6, 9, 30, 120, 300]))]
        out += [" ".join(base)] * 2
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 45) + 2)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            if r.random() < 0.3:
                copy += [r.choice(vocabulary) for _ in range(len(base) // 12 + 1)]
            out.append(" ".join(copy).title() if r.random() < 0.2 else " ".join(copy))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed, words, similarity", [(1, 4, (85, 100)), (2, 5, (80, 100))])
def test_against_brute_force(tables, seed, words, similarity):
    texts = corpus(seed)
    docs = tables([(d, t, "x", 1) for d, t in texts], "doc_id long, text string, component string, key int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(docs, words, similarity).collect()}
    assert got == brute(texts, words, *similarity)


def test_blocks_of_a_large_family(tables, monkeypatch):
    monkeypatch.setattr("stepwise.llm.ngram_join.BLOCK", 5)
    texts = corpus(3, families=2, size=30)
    docs = tables(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(docs, 4, (85, 100)).collect()}
    assert got == brute(texts, 4, 85, 100)


def test_odd_tables(tables):
    assert similar_groups(tables([], "doc_id long, text string")).collect() == []
    got = similar_groups(tables([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, "z")], "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == sorted(
        [(5, 2, 5), (5, 2, 5), (None, 2, None), (None, 0, None), (3, 1, 3)], key=str
    )


def test_similar_sets_share_a_signature():
    r = np.random.default_rng(4)
    for size in (6, 7, 12, 40, 150, 600, 2500):
        for _ in range(40):
            a = r.integers(0, 2**63, size, dtype=np.uint64)
            union_loss = int(size * 0.15 / 1.0)
            drop = int(r.integers(0, union_loss + 1))
            b = np.concatenate([a[drop:], r.integers(0, 2**63, int(r.integers(0, 4)), dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                assert len(np.intersect1d(signatures(np.unique(a), 85, 100), signatures(np.unique(b), 85, 100)))
                x, y = (np.unpackbits(np.frombuffer(sketch(s, 85, 100), np.uint8)) for s in (a, b))
                n = min(len(x), len(y))
                apart = (x.reshape(-1, n).sum(0) % 2 != y.reshape(-1, n).sum(0) % 2).sum()
                assert apart <= len(a) + len(b) - 2 * both


def test_few_sizes_need_no_signature():
    assert [bool(instances(n, 85, 100)) for n in (1, 3)] == [False, False]
    assert instances(6, 85, 100)


def test_shingles_of_slices_and_nulls():
    texts = pa.array(["x y z", None, "", "A b c d a B C D", "a b c d"])
    a, b, c, d, e = shingle_sets(texts, 4)
    assert [len(s) for s in (a, b, c, d, e)] == [1, 0, 0, 4, 1] and e[0] in d
    assert [s.tolist() for s in shingle_sets(texts.slice(3, 2), 4)] == [d.tolist(), e.tolist()]
    assert [len(s) for s in shingle_sets(pa.array([None, None], pa.string()), 4)] == [0, 0]


def test_components(tables):
    r = random.Random(6)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100), (7, 7)] + [(200 + r.randrange(30), 200 + r.randrange(30)) for _ in range(25)] + [(None, 3)]
    got = {x.node: x.component for x in connected_components(tables(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(tables([], "a long, b long")).collect() == []


def test_sets_of_rows_that_share_an_id(tables):
    from stepwise.llm.ngram_join import _sets
    from stepwise.llm.shingles import digest

    texts = [" ".join(f"w{k}x{n}" for n in range(8)) for k in range(20)]
    keys = [digest(s)[0] for s in shingle_sets(pa.array(texts), 4)]
    docs, ids = tables([(1, t) for t in texts], "_id long, _text string"), tables([(1, k) for k in keys], "_id long, key long")
    got = {r.key: r["items"] for r in _sets(docs, ids, 4).collect()}
    assert set(got) == set(keys)
    assert all(digest(np.array(v, dtype=np.int64).view(np.uint64))[0] == k for k, v in got.items())


def test_long_words_are_told_apart(tables):
    """Thue-Morse strings, on which every polynomial modulo a power of two fails."""
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    words = [a, b, a + "\0", a[:-1], a[8:16] + a[:8] + a[16:], "x" * 8, "x" * 16, "x" * 7]
    one = shingle_sets(pa.array(words), 4)
    assert len({int(s[0]) for s in one}) == len(words)
    both = f"{a} u v w {b} u v w {a} u"
    docs = tables([(1, f"{a} u v w"), (2, f"{b} u v w"), (3, both)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(docs, 4, (85, 100)).collect()}
    assert got == brute([(1, f"{a} u v w"), (2, f"{b} u v w"), (3, both)], 4, 85, 100) and got[3][0] == 7


def test_sets_that_share_a_key(tables, monkeypatch):
    """With three bits for a key nearly every set shares one."""
    import stepwise.llm.ngram_join as module

    whole = module.digest

    def few(items):
        return whole(items)[0] % 8, whole(items)[1]

    def key(items, clashes):
        one, other = few(items)
        return one ^ other if one in clashes else one

    # both go to the workers by value
    monkeypatch.setattr(module, "digest", few)
    monkeypatch.setattr(module, "_key", key)
    texts = corpus(8, families=4, size=5)
    docs = tables(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(docs, 4, (85, 100)).collect()}
    assert got == brute(texts, 4, 85, 100)


def test_hubs_are_split(tables, monkeypatch):
    monkeypatch.setattr("stepwise.llm.common.HEAVY", 3)
    texts = corpus(9, families=3, size=12) + [(1000 + k, "one text that very many documents have") for k in range(40)]
    docs = tables(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(docs, 4, (85, 100)).collect()}
    assert got == brute(texts, 4, 85, 100)


def test_one_row_leads_each_group(tables):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "q r s t u v"), (None, "a b c d e f"), (None, "k l m n o"), (None, "k l m n o"), (7, "k l m n"), (8, None), (8, "")]
    got = similar_groups(tables(rows, "doc_id long, text string"), 4, (85, 100)).collect()
    assert sorted(((r.doc_id, r.n_shingles) for r in got if r.leads), key=str) == sorted([(5, 3), (5, 3), (5, 3), (None, 2), (None, 2), (7, 1), (8, 0), (8, 0)], key=str)
