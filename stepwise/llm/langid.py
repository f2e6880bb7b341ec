"""Language identification by cross-parsing against suffix automata.

For every language a bounded sample of labelled text is turned into a suffix automaton, which
recognises exactly the substrings of the sample.  A text is cut greedily into the longest phrases
that occur in the sample; a letter that the sample lacks is a phrase of its own.  A language is the
likelier the fewer phrases it needs, each weighted with the logarithm of the sample's length (the
cost of pointing into it).  The cheapest language wins.

Greedy parsing only ever restarts at the root, so the automaton becomes a transition table, packed
into one array by row displacement.  Texts are parsed whole but not one letter after the other: all
blocks of all texts are parsed at once as if each began a text.  Then the true state in which the
parser enters a block is followed until it meets the state assumed there, which takes a few phrases;
what follows is the same.  Where they don't meet soon, as in a word said over and over, that text is
parsed letter by letter until they do.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sample of a language: at most about so many documents, so many letters of each from a place that the id's hash names.
SAMPLE_DOCS, DOC_CHARS = 96, 500
#: At most so many languages can be learned; more are an error.
MAX_LANGUAGES = 64
#: Letters of a text that are parsed in one go, and blocks that step together.
BLOCK, LANES = 512, 4_096
#: Letters over which all blocks at once wait for the true and the assumed state to meet.
PATIENCE = 96
#: Cost (nats a symbol) above which no language fits, and a text counts as rejected.
MAX_COST = 6.0


@dataclass(frozen=True)
class Model:
    """The parsers of all languages in common arrays.

    A state is a number; ``base[state] + symbol`` is a place, which belongs to the state if ``owner`` says
    so and then has the next state in ``target``.  ``starts`` has each language's first state, ``costs``
    what a phrase costs, ``codes`` the symbol of each character, 0 for one that no sample has.
    """

    languages: tuple[str, ...]
    codes: np.ndarray
    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    starts: np.ndarray
    costs: np.ndarray


_NOT_LETTERS = re.compile(r"[\W\d_]+")


@cache
def _numerals() -> tuple[frozenset[str], dict[int, str]]:
    """Characters that count as word characters but are no letters (Unicode category L), and blanks for them."""
    found = [c for c in range(0x110000) if chr(c).isalnum() and not chr(c).isalpha()]
    return frozenset(map(chr, found)), dict.fromkeys(found, " ")


def normalise(text: str) -> str:
    """Lower case, with every run of characters that are not letters as one space."""
    text = text.lower()
    if not text.isascii() and not _numerals()[0].isdisjoint(text):
        text = text.translate(_numerals()[1])
    return _NOT_LETTERS.sub(" ", text).strip(" ")


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``symbols``; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at >= 0:
            to = step[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                split = len(step)
                step.append(dict(step[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and step[at].get(c) == to:
                    step[at][c] = split
                    at = link[at]
                link[to] = link[new] = split
        last = new
    return step


def pack(automata: list[list[dict[int, int]]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(base, owner, target, first states): the transitions of all automata in one array.

    Each state's row is laid where its symbols meet free places, the fullest rows first; rows of one
    symbol fill the gaps.
    """
    firsts, rows = [], []
    for step in automata:
        firsts.append(len(rows))
        rows += [{c: to + firsts[-1] for c, to in r.items()} for r in step]
    size = sum(map(len, rows)) + 2 * width + 1
    base, owner, target = np.zeros(len(rows), dtype=np.int32), [-1] * size, [0] * size
    by_size = sorted(range(len(rows)), key=lambda s: -len(rows[s]))
    free, at = 0, 0
    for state in by_size:
        row = rows[state]
        if not row:
            break
        symbols = list(row)
        if len(symbols) == 1:
            while owner[free] >= 0 or free < width:
                free += 1
                if free >= len(owner):
                    owner.append(-1)
                    target.append(0)
            offset = free - symbols[0]
        else:
            low = min(symbols)
            offset = max(0, at - low)
            tries = 0
            while True:
                while offset + width >= len(owner):
                    owner += [-1] * size
                    target += [0] * size
                if all(owner[offset + c] < 0 for c in symbols):
                    break
                offset += 1
                tries += 1
            if tries > 4 * width:  # what lies before is full but for small gaps
                at = offset + low
        base[state] = offset
        for c in symbols:
            owner[offset + c], target[offset + c] = state, row[c]
    # a state without transitions must not own a place, nor reach beyond the end
    end = max((k for k, s in enumerate(owner) if s >= 0), default=0) + width + 1
    owner += [-1] * max(0, end - len(owner))
    target += [0] * max(0, end - len(target))
    return base, np.array(owner[:end], dtype=np.int32), np.array(target[:end], dtype=np.int32), firsts


def build(samples: dict[str, str]) -> Model:
    """The parsers of the languages' samples, which are normalised texts."""
    letters = sorted({c for t in samples.values() for c in t})
    codes = np.zeros(0x110000, dtype=np.int32 if len(letters) > 60_000 else np.uint16)
    for k, c in enumerate(letters):
        codes[ord(c)] = k + 1
    names = sorted(samples)
    automata = [suffix_automaton(codes[np.frombuffer(samples[n].encode("utf-32-le"), dtype=np.uint32)].tolist()) for n in names]
    base, owner, target, firsts = pack(automata, len(letters) + 1)
    costs = [math.log(max(2, len(samples[n]))) for n in names]
    return Model(tuple(names), codes, base, owner, target, np.array(firsts, dtype=np.int32), np.array(costs))


def _step(model: Model, roots: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(next state, phrases ended) of parsers whose roots are ``roots``."""
    at = model.base[state] + symbol
    known = model.owner[at] == state
    if known.all():
        return model.target[at], np.zeros(state.shape, dtype=np.int32)
    again = model.base[roots] + symbol
    starts = model.owner[again] == roots
    # a phrase ends before a letter that cannot follow; a letter that no phrase begins with is one itself
    ended = np.where(known, 0, (state != roots).astype(np.int32) + ~starts)
    return np.where(known, model.target[at], np.where(starts, model.target[again], roots)), ended


def phrases(model: Model, texts: list[str]) -> np.ndarray:
    """The number of phrases of each normalised text (rows) in each language (columns)."""
    n_lang = len(model.languages)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    symbols = model.codes[np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)].astype(np.int32)
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(texts)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
    length = np.minimum(BLOCK, np.repeat(sizes, blocks) - nth * BLOCK)
    ends = np.empty((n_lang, len(owner)), dtype=np.int32)
    counts = np.zeros((n_lang, len(owner)), dtype=np.int64)
    order = np.argsort(-length, kind="stable")
    for at in range(0, len(order), LANES):
        lanes = order[at : at + LANES]
        lane_begin, lane_length = begin[lanes], length[lanes]
        state = np.repeat(model.starts[:, None], len(lanes), axis=1)
        ended = np.zeros((n_lang, len(lanes)), dtype=np.int32)
        # lanes are in falling order of length, so those still at work are the first ones
        alive = np.searchsorted(-lane_length, -np.arange(lane_length[0]), side="left")
        for t, n in enumerate(alive):
            roots = np.broadcast_to(model.starts[:, None], (n_lang, n))
            state[:, :n], now = _step(model, roots, state[:, :n], symbols[lane_begin[:n] + t])
            ended[:, :n] += now
        ends[:, lanes], counts[:, lanes] = state, ended
    _connect(model, symbols, begin, length, nth, ends, counts)
    out = np.zeros((len(texts), n_lang), dtype=np.int64)
    last = np.cumsum(blocks) - 1
    for k in range(n_lang):
        out[:, k] = np.bincount(owner, weights=counts[k], minlength=len(texts))
        some = sizes > 0
        out[some, k] += ends[k, last[some]] != model.starts[k]  # the phrase in which the text ends
    return out


def _connect(model: Model, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, nth: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> None:
    """Correct ``counts`` and ``ends`` of blocks, parsed as if they began a text, for the states they are entered in."""
    later = np.flatnonzero(nth > 0)
    lang, block = np.repeat(np.arange(len(ends)), len(later)), np.tile(later, len(ends))
    roots = model.starts[lang]
    true, other = ends[lang, block - 1], roots.copy()
    delta = np.zeros(len(lang), dtype=np.int64)
    live = np.flatnonzero(true != other)
    for t in range(PATIENCE):
        live = live[length[block[live]] > t]
        if not len(live):
            break
        symbol = symbols[begin[block[live]] + t]
        true[live], more = _step(model, roots[live], true[live], symbol)
        other[live], less = _step(model, roots[live], other[live], symbol)
        delta[live] += more - less
        live = live[true[live] != other[live]]
    assumed = counts.copy()
    counts[lang, block] += delta
    apart = np.flatnonzero(true != other)
    if not len(apart):
        return
    tables = [memoryview(np.ascontiguousarray(x)) for x in (model.base, model.owner, model.target)]
    at_hand = {(int(lang[k]), int(block[k])): (int(true[k]), int(other[k])) for k in apart}
    for n, b in sorted(at_hand):
        root, place = int(model.starts[n]), PATIENCE
        state = at_hand.get((n, b))
        while state is not None:  # of a block, and of those after it while the states don't meet
            at_hand[n, b] = None
            text = symbols[begin[b] + place : begin[b] + length[b]].tolist()
            one, two, more = _follow(*tables, root, *state, text)
            counts[n, b] = (counts[n, b] if place else assumed[n, b]) + more
            if one == two:
                break
            ends[n, b] = one
            b += 1
            if b == len(nth) or not nth[b]:
                break
            # entered in another state than was assumed above
            place, state = 0, (one, root)


def _follow(base: memoryview, owner: memoryview, target: memoryview, root: int, one: int, two: int, text: list[int]) -> tuple[int, int, int]:
    """The states of two parsers where they meet, or at the end of ``text``, and how many phrases more the first one ends."""
    more = 0
    for c in text:
        at = base[one] + c
        if owner[at] == one:
            one = target[at]
        else:
            more += one != root
            at = base[root] + c
            if owner[at] == root:
                one = target[at]
            else:
                more, one = more + 1, root
        at = base[two] + c
        if owner[at] == two:
            two = target[at]
        else:
            more -= two != root
            at = base[root] + c
            if owner[at] == root:
                two = target[at]
            else:
                more, two = more - 1, root
        if one == two:
            break
    return one, two, more


def phrase_costs(model: Model, texts: list[str]) -> np.ndarray:
    """Cost in nats a symbol of each normalised text (rows) under each language (columns)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    return phrases(model, texts) * model.costs[None, :] / np.maximum(sizes, 1)[:, None]


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn each language of ``labelled`` from a sample.

    The labels are counted over all rows; more than ``MAX_LANGUAGES`` are an error.  Of each language
    about ``SAMPLE_DOCS`` documents with the smallest hashes of id and text are fetched, or rather a
    passage of ``DOC_CHARS`` letters of each, which begins where the hash says.  Rows without label,
    text or letters teach nothing; rows that repeat teach once.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return build({})
    # hashes are 0..2^32-1; a language of n rows keeps those below 2^32 * SAMPLE_DOCS / n
    mark = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(2**32))
    bound: Column = F.create_map(*[F.lit(x) for r in sizes for x in (r[0], int(2**32 * min(1.0, SAMPLE_DOCS / r[1])))])
    taken = 2 * DOC_CHARS
    place = F.pmod(F.col("mark"), F.greatest(F.length("text") - taken, F.lit(0)) + 1).cast("int")
    sample = (
        rows.select(F.col(lang_col).alias("lang"), mark.alias("mark"), F.col(text_col).alias("text"))
        .where(F.col("mark") <= bound[F.col("lang")])
        .select("lang", "mark", F.substring("text", place + 1, F.lit(taken)).alias("text"))
        .groupBy("lang", "mark")
        .agg(F.min("text").alias("text"))  # rows that repeat have one hash, so there are about SAMPLE_DOCS of a language
        .orderBy("mark", "lang")
        .limit(4 * SAMPLE_DOCS * len(sizes))
        .collect()
    )
    texts: dict[str, list[str]] = {}
    for row in sample:
        texts.setdefault(row.lang, []).append(normalise(row.text)[:DOC_CHARS])
    joined = {lang: " ".join(dict.fromkeys(t for t in parts if t)) for lang, parts in texts.items()}
    return build({lang: text for lang, text in joined.items() if text})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_rows: bool = False) -> DataFrame:
    """Predict the language of every whole text.

    Returns the id, ``lang_pred``, ``score`` and ``cost``; with ``keep_rows`` all columns of ``docs``
    and then ``lang_pred``, ``score`` and ``cost`` (which replace columns of those names).  ``cost``
    is the winner's cost in nats a symbol; ``score`` (0 to 1) is how much cheaper the winner is than
    the runner-up, as a part of the runner-up's cost, 1 if there is but one language.

    Cases: a null text, a text without a letter, and any text under a model without languages give
    ``und``, score 0 and a null cost; ties go to the language that sorts first; rows that repeat are
    predicted one by one; an empty table gives an empty result.
    """
    added = {"lang_pred", "score", "cost"}
    kept = [c for c in docs.columns if c.lower() not in added] if keep_rows else [id_col]
    at = kept.index(text_col) if text_col in kept else len(kept)  # the text travels once
    chosen = docs.select(*kept, *([] if at < len(kept) else [F.col(text_col).alias("_text")]))
    names = model.languages
    # some ten bytes for each letter learned, of which there are SAMPLE_DOCS * DOC_CHARS a language
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                texts = [normalise(t) if t else "" for t in part.column(at).to_pylist()]
                cost = phrase_costs(shared.value, texts) if names else np.zeros((len(texts), 0))
                best, score, least = ["und"] * len(texts), np.zeros(len(texts)), [None] * len(texts)
                for k, t in enumerate(texts):
                    if t and names:
                        rank = np.argsort(cost[k], kind="stable")
                        best[k], least[k] = names[rank[0]], float(cost[k, rank[0]])
                        second = cost[k, rank[1]] if len(rank) > 1 else math.inf
                        score[k] = 1.0 if second == math.inf else (second - least[k]) / second
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(kept)], pa.array(best), pa.array(score), pa.array(least, pa.float64())],
                    names=[*kept, "lang_pred", "score", "cost"],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return chosen.mapInArrow(run, f"{fields}, lang_pred string, score double, cost double")


def _pieces(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of the batch of about ``most`` bytes, so that memory stays bounded."""
    rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def has_language(predicted: DataFrame, max_cost: float = MAX_COST) -> DataFrame:
    """The rows of ``identify`` in which a language was recognised: none is ``und`` or fits badly."""
    return predicted.where((F.col("lang_pred") != "und") & (F.col("cost") <= max_cost))
