import random

from stepwise.llm.decontaminate import Matcher, best_match, budget, character_masks, drop_leaks, find_leaks, normalise, pieces

ITEM = "That which the river carried away in the spring came back to the village before the winter of the following year"


def least(item, text):
    """Least edit distance of the item to a substring, by the table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def edited(text, edits, seed):
    r, out = random.Random(seed), list(text)
    for _ in range(edits):
        at = r.randrange(len(out))
        kind = r.choice("ris")
        if kind == "r":
            out[at] = r.choice("abc")
        elif kind == "i":
            out.insert(at, r.choice("abc"))
        else:
            out.pop(at)
    return "".join(out)


def test_myers_equals_the_table():
    r = random.Random(1)
    for _ in range(400):
        item = "".join(r.choice("ab ") for _ in range(r.randint(1, 70)))
        text = "".join(r.choice("ab ") for _ in range(r.randint(0, 90)))
        assert best_match(item, text)[0] == least(item, text)


def test_matcher_finds_what_brute_force_finds():
    item = normalise(ITEM)
    matcher = Matcher([(1, item), (2, normalise("short text"))])
    for seed in range(60):
        text = normalise(f"before words {edited(item, seed % 12, seed)} and after")
        expected = least(item, text)
        got = matcher.find(text).get(0)
        assert (got is not None and got[0] == expected) if expected <= budget(item) else got is None
    assert "".join(p for _, p in pieces(item, 6)) == item and len(pieces(item, 6)) == 7


def test_tables(tables):
    docs = tables(
        [(1, f"Intro. {ITEM.upper()}!"), (2, "nothing here"), (3, None), (4, ""), (5, f"x {edited(ITEM, 3, 9)} y"), (5, f"x {edited(ITEM, 3, 9)} y"), (6, f"{ITEM} " * 400), (7, ITEM[:60])],
        "doc_id long, text string",
    ).selectExpr("doc_id", "text", "'z' AS distance", "1 AS item_id")
    items = tables([(10, ITEM), (11, ITEM), (12, None), (13, "?!"), (None, ITEM)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance > 0) for r in find_leaks(docs, items).collect())
    assert got == sorted([(d, i, d == 5) for d in (1, 5, 5, 6) for i in (10, 11)])
    kept = drop_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 7]
    assert find_leaks(docs, tables([], "item_id long, text string")).collect() == []
    assert find_leaks(docs.limit(0), items).collect() == [] and drop_leaks(docs.limit(0), items).collect() == []


def test_many_blocks_pass_once(tables, monkeypatch):
    """Items in more blocks than a process keeps, texts in many chunks: as with all items together."""
    from stepwise.llm import decontaminate as module

    r = random.Random(4)
    texts = [(k, f"intro {k} {edited(ITEM, k % 9, k)} {'x y z ' * r.randrange(50)}") for k in range(40)]
    items = [(k, f"{ITEM[k * 3:]} number {k}") for k in range(12)] + [(50, ITEM)]
    docs, table = tables(texts, "doc_id long, text string"), tables(items, "item_id long, text string")
    whole = sorted(map(tuple, find_leaks(docs, table).collect()))
    left = sorted(x.doc_id for x in drop_leaks(docs, table).collect())
    for name, value in (("BLOCK_CHARS", 150), ("KEPT_CHARS", 300), ("CHUNK_BYTES", 1_000)):
        monkeypatch.setattr(module, name, value)
    benchmark = module.Benchmark(table, "item_id", "text", 6)
    (batch,) = docs.toArrow().combine_chunks().to_batches()
    found = [(part.column(0)[k].as_py(), hit[0]) for part, hits in benchmark.find(iter([batch]), 1) for k, row in enumerate(hits) for hit in row]
    assert len(benchmark.blocks) > 4 and sorted(found) == [(d, i) for d, i, *_ in whole] and len(module._BUILT) <= 3
    assert left == sorted(set(range(40)) - {d for d, *_ in whole})


def test_query_against_brute_force(spark):
    """Myers over whole texts, every document with every item."""
    from stepwise.llm.queries import op9_decontamination

    sf_dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: normalise(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: normalise(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.distance for r in op9_decontamination(spark, sf_dir).collect()}
    masks = {i: character_masks(x) for i, x in items.items()}
    expected = {}
    for d, text in docs.items():
        for i, item in items.items():
            distance = 0 if item in text else best_match(item, text, masks[i])[0]
            if distance <= budget(item):
                expected[d, i] = distance
    assert got == expected
