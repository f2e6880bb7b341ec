"""Exact n-gram Jaccard self-join with PartEnum signatures, as connected groups of documents.

1. Every text becomes its set of shingles, a digest of it and a parity sketch; equal sets are one set
   from here on.  The digest has 128 bits, of which 64 are the set's key; of keys that two sets turn
   out to share, the other half becomes a part.
2. Every set is dealt out by its signatures.  The sets of one signature form a bucket; of buckets with
   the same sets one is kept.
3. In each bucket the sketches are compared.  A sketch has a bit for each cell of the hashed domain,
   the parity of the set's elements there, so two sets differ in at least as many elements as their
   sketches in bits; pairs that differ too much are no links.  The others give families of sets, and
   every link joins two sets of one family.
4. The whole sets of each family meet: first all with the family's first set, then those without a
   link to it with all others.
5. The verified links give the groups.

Large buckets and families are cut into blocks of bounded size, and every pair of blocks is a unit of
work of its own; only links that join two groups leave a unit.  Two similar sets share a bucket, their
sketches pass, and step 4 compares them unless they are already joined, so no link between groups is
lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, hub_join, shuffle_width
from .graph import connected_components
from .partenum import signatures
from .shingles import digest, mix, shingle_sets

#: Sets that meet in one unit of work: at most two blocks of so many.
BLOCK = 512
#: A table of at most so many keys is broadcast.
BROADCAST_KEYS = 1_000_000
#: Texts hashed at once, in bytes, and keys that a task remembers in order not to repeat itself.
PIECE_BYTES, REMEMBERED = 1_000_000, 200_000


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = max(1, int(batch.num_rows * PIECE_BYTES / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def sketch(items: np.ndarray, num: int, den: int) -> bytes:
    """The parity sketch of a set, of about eight bits for each element that a similar set may lack."""
    bits = 256
    while bits < 16_384 and bits < 8 * len(items) * 2 * (den - num) // (den + num):
        bits *= 2
    cells = (mix(items ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _fold(words: np.ndarray, length: int) -> np.ndarray:
    """A sketch (bits) as one of fewer cells: cells that are equal modulo the length are added up."""
    return np.bitwise_xor.reduce(words.reshape(-1, length), axis=0)


def _key(items: np.ndarray, clashes: frozenset[int]) -> int:
    """The key of a set; ``clashes`` are the first halves of a digest that different sets share."""
    key, check = digest(items)
    return key ^ check if key in clashes else key


def _keys(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(_id, key, check, n, sketch) of each row of ``docs`` (_id, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                sets = shingle_sets(part.column(1), words)
                digests = np.array([digest(s) for s in sets], dtype=np.int64).reshape(-1, 2)
                sizes = pa.array([len(s) for s in sets], pa.int64())
                sketches = pa.array([sketch(s, num, den) if len(s) else None for s in sets], pa.binary())
                halves = [pa.array(np.ascontiguousarray(digests[:, h])) for h in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *halves, sizes, sketches], names=["_id", "key", "check", "n", "sketch"])

    return docs.mapInArrow(run, f"_id {docs.schema['_id'].dataType.simpleString()}, key long, check long, n long, sketch binary")


def _distinct_sets(keys: DataFrame) -> DataFrame:
    """(key, first, n, sketch, low, high) of the different sets; ``first`` is the first row's _id."""
    return checkpoint(
        keys.where("n > 0")
        .groupBy("key")
        .agg(F.min("_id").alias("first"), F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.min("check").alias("low"), F.max("check").alias("high"))
    )


def _signed(docs: DataFrame, words: int, num: int, den: int, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """(sign, key): the signatures of each set.  A task gives a set's signatures once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in _pieces(batch):
                signs, keys = [], []
                for items in shingle_sets(part.column(0), words):
                    key = _key(items, clashes)
                    if len(items) and key not in seen:
                        if len(seen) < REMEMBERED:
                            seen.add(key)
                        signs.append(signatures(items, num, den))
                        keys.append(np.full(len(signs[-1]), key, dtype=np.int64))
                if signs:
                    columns = [np.concatenate(signs).view(np.int64), np.concatenate(keys)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sign", "key"])

    return docs.select("_text").mapInArrow(run, "sign long, key long")


def _bucketed(signed: DataFrame) -> DataFrame:
    """(sign, key): the buckets of at least two sets.

    The rows arrive sorted and pass as a stream; of a bucket only the first and the last key are held.
    """
    spark = signed.sparkSession
    ordered = signed.repartition(shuffle_width(spark), "sign").sortWithinPartitions("sign", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = center = last = None  # of the bucket at the end of the batches so far
        told = False
        for batch in batches:
            if not batch.num_rows:
                continue
            s, k = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.ones(len(s), dtype=bool)  # starts a bucket
            new[1:] = s[1:] != s[:-1]
            new[0] = sign is None or s[0] != sign
            fresh = new.copy()  # is the first row of its set in the bucket
            fresh[1:] |= k[1:] != k[:-1]
            fresh[0] |= k[0] != last
            heads = np.flatnonzero(new)
            nth = np.searchsorted(heads, np.arange(len(s)), side="right") - 1
            others = fresh & ~new
            out_s, out_k = s[others], k[others]
            # a bucket's first set is given when its second one is seen
            firsts = np.unique(nth[others])
            if len(firsts) and firsts[0] < 0:
                if not told:
                    out_s, out_k = np.append(out_s, sign), np.append(out_k, center)
                firsts = firsts[1:]
            at = heads[firsts] if len(firsts) else np.zeros(0, dtype=np.int64)
            out_s, out_k = np.append(out_s, s[at]), np.append(out_k, k[at])
            told = bool(others[heads[-1] :].any()) if len(heads) else told or bool(others.any())
            center = k[heads[-1]] if len(heads) else center
            sign, last = s[-1], k[-1]
            if len(out_s):
                columns = [pa.array(c.astype(np.int64)) for c in (out_s, out_k)]
                yield pa.RecordBatch.from_arrays(columns, names=["sign", "key"])

    return ordered.mapInArrow(run, "sign long, key long")


def _similar(a: str, b: str, num: int, den: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both * den >= (F.size(a) + F.size(b) - both) * num


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _sets(docs: DataFrame, ids: DataFrame, words: int, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """(key, items) of the documents of ``ids`` (_id, key); one row for each key.

    Only texts with the key's own set count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                wanted, sets = part.column(0).to_pylist(), shingle_sets(part.column(1), words)
                own = [k for k, items in enumerate(sets) if _key(items, clashes) == wanted[k]]
                sets = [sets[k] for k in own]
                sizes = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                items = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(sizes), items)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own, pa.int64())), lists], names=["key", "items"])

    chosen = docs.join(_few(ids), "_id").select("key", "_text")
    return chosen.mapInArrow(run, "key long, items array<long>").dropDuplicates(["key"])


def _join(i: int, linked: np.ndarray, rest: np.ndarray, keys: np.ndarray, groups: np.ndarray, links: list) -> None:
    """Note the links of set ``i`` that join two groups, which then count as one."""
    for j in np.flatnonzero(rest & linked):
        if groups[j] != groups[i]:
            links.append((int(keys[i]), int(keys[j])))
            groups[groups == groups[j]] = groups[i]


def _others(i: int, groups: np.ndarray, halves: np.ndarray, two: bool) -> np.ndarray | None:
    """The sets that set ``i`` meets: of another group and, in a unit of two blocks, of the second one."""
    if two and halves[i]:
        return None
    rest = groups != groups[i]
    rest &= (halves == 1) if two else (np.arange(len(groups)) > i)
    return rest if rest.any() else None


def _sketch_links(keys: np.ndarray, groups: np.ndarray, halves: np.ndarray, sizes: np.ndarray, sketches: list[bytes], num: int, den: int) -> list:
    length = min(map(len, sketches))
    bits = np.stack([_fold(np.frombuffer(s, dtype=np.uint8), length) for s in sketches]).view(np.uint64)
    two, links = halves.min() != halves.max(), []
    for i in range(len(keys)):
        if (rest := _others(i, groups, halves, two)) is not None:
            apart = np.bitwise_count(bits ^ bits[i]).sum(axis=1)
            _join(i, apart <= (sizes + sizes[i]) * (den - num) // (den + num), rest, keys, groups, links)
    return links


def _set_links(keys: np.ndarray, groups: np.ndarray, halves: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list:
    sizes = np.array([len(s) for s in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    bounds = np.cumsum(sizes)
    present = np.zeros(int(place.max()) + 1, dtype=bool)
    two, links = halves.min() != halves.max(), []
    for i in range(len(keys)):
        if (rest := _others(i, groups, halves, two)) is not None:
            mine = place[bounds[i] - sizes[i] : bounds[i]]
            present[mine] = True
            shared = np.bincount(owner, weights=present[place], minlength=len(sets)).astype(np.int64)
            present[mine] = False
            _join(i, shared * den >= (sizes + sizes[i] - shared) * num, rest, keys, groups, links)
    return links


def _units(rows: DataFrame, payload: list[str], links_of: Callable[[list[list]], list]) -> DataFrame:
    """(a, b): what ``links_of`` returns for each unit of ``rows`` (unit, half, then ``payload``).

    The units arrive one after the other; one unit is held at a time, and its size is bounded.
    """
    ordered = rows.select("unit", "half", *payload).repartition(shuffle_width(rows.sparkSession), "unit")
    ordered = ordered.sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            links = links_of(held) if len(held) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])
            held.clear()

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            for row, unit in enumerate(batch.column(0).to_pylist()):
                if unit != now:
                    yield from done()
                    now = unit
                held.append([c[row] for c in columns])
        yield from done()

    return ordered.mapInArrow(run, "a long, b long")


def _integers(held: list[list], *columns: int) -> list[np.ndarray]:
    return [np.array([row[c] for row in held], dtype=np.int64) for c in columns]


def _families(buckets: DataFrame, of_key: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component): families of sets by their sketches, from ``buckets`` and (key, n, sketch)."""
    kept = (
        buckets.groupBy("sign")
        .agg(F.count(F.lit(1)).alias("n_sets"), F.sum(F.xxhash64("key").cast("decimal(20,0)")).alias("sum"))
        .groupBy("n_sets", "sum")
        .agg(F.min("sign").alias("sign"))
    )
    rows = buckets.select("sign", "key").join(kept.select("sign", "n_sets"), "sign")
    blocks = F.ceil(F.col("n_sets") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("key", "sign"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.struct("sign", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).alias("_of"),
        (F.col("own") > F.col("other")).cast("int").alias("half"),
        "key",
    )
    rows = rows.withColumn("unit", F.concat_ws(":", "_of.sign", "_of.x", "_of.y")).drop("_of").join(of_key, "key")

    def links_of(held: list[list]) -> list:
        halves, keys, sizes = _integers(held, 0, 1, 2)
        return _sketch_links(keys, np.arange(len(keys)), halves, sizes, [r[3] for r in held], num, den)

    return connected_components(_units(rows, ["key", "n", "sketch"], links_of))


def _rest(members: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links in families that the first set alone doesn't hold together.

    ``members`` has component, key, items and ``tied`` (1: linked with the family's first set).  The sets
    that aren't tied meet each other and the tied ones.
    """
    counts = members.groupBy("component").agg(F.sum("tied").alias("ties"), F.sum(1 - F.col("tied")).alias("loose")).where("loose > 0")
    size = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    rows = members.join(counts.select("component", size("ties").alias("p"), size("loose").alias("q")), "component")
    own = F.pmod(F.xxhash64("key"), F.when(F.col("tied") == 1, F.col("p")).otherwise(F.col("q"))).cast("int")
    rows = rows.withColumn("own", own)
    # blocks of loose sets are numbered from 0, those of tied sets from q on
    meets = F.when(F.col("tied") == 1, F.sequence(F.lit(0), F.col("q") - 1)).otherwise(F.sequence(F.lit(0), F.col("q") + F.col("p") - 1))
    rows = rows.withColumn("own", F.col("own") + F.when(F.col("tied") == 1, F.col("q")).otherwise(0))
    rows = rows.withColumn("other", F.explode(meets)).select(
        F.concat_ws(":", "component", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
        (F.col("own") > F.col("other")).cast("int").alias("half"),
        "key",
        F.when(F.col("tied") == 1, F.col("component")).otherwise(F.col("key")).alias("group"),
        "items",
    )

    def links_of(held: list[list]) -> list:
        halves, keys, groups = _integers(held, 0, 1, 2)
        return _set_links(keys, groups, halves, [r[3] for r in held], num, den)

    return _units(rows, ["key", "group", "items"], links_of)


def similar_groups(
    docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of at least ``similarity`` (a fraction).

    Returns the id, ``n_shingles`` (size of the set), ``component_id`` (the smallest id reachable by
    links, itself included), ``set_key`` (equal for equal sets), ``text_hash`` (of the text, to tell rows
    of one id apart) and ``leads``: whether the row is the one that stands for its group, or equal to it.

    Cases: null, empty and wordless texts have empty sets and are alone; a text of fewer words than a
    shingle has one shingle; rows that repeat are rows of one group, and rows of one id with different
    texts are documents of their own that share that id; rows with a null id take part and come back with
    a null component, and stand for their group only if no other does; other columns, whatever their
    names, are ignored; an empty table gives an empty result.
    """
    num, den = similarity
    own = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    texts = docs.select(own.alias("_id"), F.col(text_col).alias("_text"))
    keys = checkpoint(_keys(texts, words, num, den))
    first = _distinct_sets(keys)
    # of n sets about n^2 / 2^65 pairs share a key: none, or a few
    clashes = frozenset(r.key for r in first.where("low != high").select("key").collect())
    if clashes:
        keys = keys.withColumn("key", F.when(F.col("key").isin(*clashes), F.col("key").bitwiseXOR(F.col("check"))).otherwise(F.col("key")))
        first = _distinct_sets(keys)
    buckets = checkpoint(_bucketed(_signed(texts, words, num, den, clashes)))
    families = _families(buckets, first.select("key", "n", "sketch"), num, den)
    members = checkpoint(families.join(first, families["node"] == first["key"]).select("component", "key", F.col("first").alias("_id")))
    sets = checkpoint(_sets(texts, members.select("_id", "key"), words, clashes).join(members.select("component", "key"), "key"))
    heads = sets.where("key = component").select("component", F.col("items").alias("head"))
    tied = (F.col("key") == F.col("component")) | _similar("items", "head", num, den)
    with_heads = hub_join(sets, heads, "component", "key", how="left")
    members = checkpoint(with_heads.select("component", "key", "items", F.coalesce(tied, F.lit(False)).cast("int").alias("tied")))
    links = members.where("tied = 1 AND key != component").select(F.col("component").alias("a"), F.col("key").alias("b"))
    found = connected_components(links.unionByName(_rest(members, num, den)))
    of_key = checkpoint(
        first.join(found, first["key"] == found["node"], "left").select("key", "first", F.coalesce("component", "key").alias("group"))
    )
    leads = of_key.groupBy("group").agg(F.min("first").alias("lead"))
    of_key = hub_join(of_key.drop("first"), leads, "group", "key").select("key", "lead")
    out = hub_join(keys.select("_id", "key", "n"), of_key, "key", "_id", how="left")
    alone = F.col("n") == 0
    return out.select(
        F.col("_id.id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(alone | F.col("_id.none"), F.col("_id.id")).otherwise(F.col("lead.id")).alias("component_id"),
        F.col("key").alias("set_key"),
        F.col("_id.hash").alias("text_hash"),
        (alone | (F.col("lead") == F.col("_id"))).alias("leads"),
    )
