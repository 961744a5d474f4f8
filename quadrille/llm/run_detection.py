"""Periodic runs of words, found in a grammar of the texts.

A batch's word ids are compressed by Re-Pair in rounds: in each, every pair that occurs twice competes
with the pairs it overlaps (the more frequent by powers of two wins, then a hash), and the winners
become nonterminals.  A run with four periods lies in one smallest nonterminal, or in its text, and
crosses the boundary of that one's two parts: so runs are looked for at the boundary of each
nonterminal once, and at those between the symbols that are left.  What is found is translated to
every place of the derivation, and intervals of one period that overlap are merged.

Periods at a boundary: up to ``SMALL`` each is tried; for the others, names of stretches of 2^k words
(by doubling) tell how far on a stretch occurs again, and six places before the boundary suffice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Periods that are tried one by one.
SMALL = 4
#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
_WORD = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)], bool)


@dataclass
class Words:
    """Words of a block of texts: ids (equal exactly for equal words), bytes, and where each text's start."""

    ids: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    data: np.ndarray
    offsets: np.ndarray  # one more than texts


def words_of(texts: list[bytes]) -> Words:
    data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    inside = _WORD[data]
    inside[ends - 1] = False
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = stops - starts
    data = data[inside]
    at = np.concatenate([[0], np.cumsum(lengths)])
    column = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(data)])
    ids = column.dictionary_encode().indices.to_numpy().astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.searchsorted(starts, ends, "left")])
    return Words(ids, at[:-1], lengths, data, offsets)


@dataclass
class Grammar:
    """Rules of two symbols each, by round, and the sequence that is left, with places in the text."""

    terminals: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray  # words
    place: np.ndarray  # of one occurrence
    rounds: list[int] = field(default_factory=list)  # rules before each round, and all
    symbols: np.ndarray = None
    places: np.ndarray = None


def _candidates(symbols: np.ndarray, joint: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Live places of pairs; in a stretch of one symbol every other one, so that none overlap."""
    same = joint.copy()
    same[:-1] &= symbols[:-1] == symbols[1:]
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same[:-1]]), np.arange(len(same)), 0))
    return np.flatnonzero(joint & live & ~(same & ((np.arange(len(same)) - first) % 2 == 1)))


def repair(ids: np.ndarray, text: np.ndarray) -> Grammar:
    """The grammar of a sequence of ids; ``text`` numbers the text of each, pairs stay inside one."""
    terminals = int(ids.max()) + 1 if len(ids) else 0
    symbols, places, live = ids.copy(), np.arange(len(ids)), np.ones(len(ids), bool)
    left, right, place, rounds = [], [], [], [0]
    while len(symbols) > 1:
        joint = np.append(text[places[1:]] == text[places[:-1]], False)
        at = _candidates(symbols, joint, live)
        keys = symbols[at] << 31 | symbols[at + 1]
        _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
        often = count[number] > 1
        live[:] = False
        at, keys, weight = at[often], keys[often], count[number][often]
        live[at] = True
        # The strength of each place's pair; a place wins over both that it shares a symbol with.
        strength = np.zeros(len(symbols) + 2, np.uint64)
        classes = np.floor(np.log2(weight)).astype(np.uint64) << np.uint64(57)
        strength[at + 1] = classes | common.mix64(keys.astype(np.uint64)) >> np.uint64(7)
        won = (strength[at + 1] > strength[at]) & (strength[at + 1] >= strength[at + 2])
        at, keys = at[won], keys[won]
        unique, first, number, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        used = count > 1
        if not used.any():
            break
        name = np.cumsum(used) - 1 + terminals + rounds[-1]
        left.append(unique[used] >> 31)
        right.append(unique[used] & ((1 << 31) - 1))
        place.append(places[at[first[used]]])
        chosen = used[number]
        at, number = at[chosen], number[chosen]
        symbols[at] = name[number]
        rounds.append(rounds[-1] + int(used.sum()))
        live[at] = True
        live[np.maximum(at - 1, 0)] = True
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        symbols, places, live = symbols[stays], places[stays], live[stays]

    def whole(parts):
        return np.concatenate([np.zeros(0, np.int64), *parts])

    g = Grammar(terminals, whole(left), whole(right), np.zeros(0, np.int64), whole(place), rounds, symbols, places)
    g.length = np.zeros(rounds[-1], np.int64)
    for a, b in zip(rounds, rounds[1:], strict=False):
        g.length[a:b] = size_of(g, g.left[a:b]) + size_of(g, g.right[a:b])
    return g


def size_of(g: Grammar, symbols: np.ndarray) -> np.ndarray:
    """Words of symbols."""
    out = np.ones(len(symbols), np.int64)
    rules = symbols >= g.terminals
    out[rules] = g.length[symbols[rules] - g.terminals]
    return out


def _next_ones(ids: np.ndarray, text: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Stretches of g = 2, 4, 8, ... words that occur again in their text: places, and how far on next."""
    places, keys = np.arange(len(ids)), text << 31 | ids
    g = 1
    while len(places):
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        again = ordered[1:] == ordered[:-1]
        after = np.zeros(len(places), np.int64)
        after[order[:-1][again]] = places[order[1:][again]] - places[order[:-1][again]]
        if g > 1:
            yield g, places, after
        if g * LEAST_PERIODS >= 2 * longest:
            return
        kept = np.zeros(len(places), bool)
        kept[order[:-1][again]] = kept[order[1:][again]] = True
        names = np.empty(len(places), np.int64)
        names[order] = np.cumsum(np.concatenate([[0], ~again]))
        places, names = places[kept], names[kept]
        at = np.searchsorted(places, places + g)
        at[at == len(places)] = 0
        both = np.flatnonzero(places[at] == places + g)
        # Names hold their text, so both halves of what occurs again are in one.
        places, keys, g = places[both], names[both] << 31 | names[at[both]], 2 * g


def _matches(ids: np.ndarray, x: np.ndarray, q: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many of ids x, x + step, ... short of ``limit`` equal the ones ``q`` further on."""
    n = np.zeros(len(x), np.int64)
    todo, block = np.arange(len(x)), 8
    while len(todo):
        nxt = []
        for part in np.array_split(todo, max(1, len(todo) * block >> 20)):
            at = x[part, None] + step * (n[part, None] + np.arange(block))
            inside = at < limit[part, None] if step > 0 else at >= limit[part, None]
            at = np.where(inside, at, 0)
            equal = inside & (ids[at] == ids[np.where(inside, at + q[part, None], 0)])
            run = np.where(equal.all(1), block, equal.argmin(1))
            n[part] += run
            nxt.append(part[run == block])
        todo, block = np.concatenate(nxt), min(2 * block, 4096)
    return n


def boundary_runs(ids: np.ndarray, text: np.ndarray, low: np.ndarray, cut: np.ndarray, high: np.ndarray):
    """(number of the boundary, start, end, period) of the runs in [low, high) that cross ``cut``.

    A run with a period over ``SMALL`` holds one of six places before the cut, half of g = 2^k (the
    least power not below the period) apart, from which a stretch of g words comes again after the period.
    """
    number, period, seed = [], [], []
    for q in range(1, SMALL + 1):
        wide = np.flatnonzero(high - low >= max(LEAST_WORDS, LEAST_PERIODS * q))
        for x in (cut[wide] - 1, cut[wide] - q):
            fits = (x >= low[wide]) & (x + q < high[wide])
            fits[fits] = ids[x[fits]] == ids[x[fits] + q]
            number.append(wide[fits])
            period.append(np.full(fits.sum(), q))
            seed.append(x[fits])
    longest = int((high - low).max()) if len(low) else 0
    for g, places, after in _next_ones(ids, text, longest):
        near = (after > max(g // 2, SMALL)) & (after <= g)
        places, after = places[near], after[near]
        if not len(places):
            continue
        wide = np.flatnonzero(high - low >= LEAST_PERIODS * (g // 2 + 1))
        for m in range(6):
            x = cut[wide] - m * (g // 2)
            at = np.searchsorted(places, x)
            at[at == len(places)] = 0
            fits = (places[at] == x) & (x >= low[wide]) & (x + after[at] < high[wide])
            number.append(wide[fits])
            period.append(after[at[fits]])
            seed.append(x[fits])
    number, period, seed = np.concatenate(number), np.concatenate(period), np.concatenate(seed)
    end = seed + _matches(ids, seed, period, high[number] - period, 1) + period
    start = seed - _matches(ids, seed - 1, period, low[number], -1)
    good = (end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)) & (start < cut[number]) & (cut[number] < end)
    return number[good], start[good], end[good], period[good]


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray):
    """Maximal intervals: of one period, those that share a period's words or more are one."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    group = np.cumsum(np.append(False, period[1:] != period[:-1])) if len(start) else period
    wide = int(end.max()) + 1 if len(end) else 1
    reach = np.maximum.accumulate(end + group * wide) - group * wide
    fresh = np.ones(len(start), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (start[1:] > reach[:-1] - period[1:])
    first = np.flatnonzero(fresh)
    return start[first], np.maximum.reduceat(end, first) if len(first) else end, period[first]


def _primitive(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which runs have no smaller period: none of a part of their period covers them."""
    ok = np.ones(len(start), bool)
    for q in range(2, SMALL + 1):
        own = np.flatnonzero(period == q)
        for part in range(1, q):
            of = np.flatnonzero(period == part)  # sorted by start, disjoint but for less than a period
            if q % part or not len(of) or not len(own):
                continue
            at = np.searchsorted(start[of], start[own], "right") - 1
            ok[own] &= ~((at >= 0) & (end[of][at] >= end[own]))
    return ok


def runs_of(ids: np.ndarray, text: np.ndarray, offsets: np.ndarray):
    """start, end, period of all runs of a block's texts, by way of its grammar."""
    g = repair(ids, text)
    rules = len(g.left)
    joins = np.flatnonzero(text[g.places[1:]] == text[g.places[:-1]]) + 1
    of = text[g.places[joins]]
    low = np.concatenate([g.place, offsets[of]])
    cut = np.concatenate([g.place + size_of(g, g.left), g.places[joins]])
    high = np.concatenate([g.place + g.length, offsets[of + 1]])
    number, start, end, period = boundary_runs(ids, text, low, cut, high)
    whole = number >= rules
    found = [(start[whole], end[whole], period[whole])]
    # Runs of nonterminals, relative to their beginning, and which nonterminals derive any.
    order = np.argsort(number[~whole], kind="stable")
    rule = number[~whole][order]
    start, end, period = (x[~whole][order] for x in (start - low[number], end - low[number], period))
    edges = np.searchsorted(rule, np.arange(rules + 1))
    hot = np.zeros(g.terminals + rules, bool)
    hot[g.terminals :] = np.diff(edges) > 0
    for a, b in zip(g.rounds, g.rounds[1:], strict=False):
        hot[g.terminals + a : g.terminals + b] |= hot[g.left[a:b]] | hot[g.right[a:b]]
    # The derivation from the top, round by round: places of nonterminals that matter.
    symbols, places = g.symbols[hot[g.symbols]], g.places[hot[g.symbols]]
    for a in reversed(g.rounds[:-1]):
        now = symbols >= g.terminals + a
        own, at = symbols[now] - g.terminals, places[now]
        count = edges[own + 1] - edges[own]
        each = np.repeat(edges[own] - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(own) else own, count) + np.arange(count.sum())
        base = np.repeat(at, count)
        found.append((base + start[each], base + end[each], period[each]))
        children = np.concatenate([g.left[own], g.right[own]])
        spots = np.concatenate([at, at + size_of(g, g.left[own])])
        symbols = np.concatenate([symbols[~now], children[hot[children]]])
        places = np.concatenate([places[~now], spots[hot[children]]])
    start, end, period = merged(*(np.concatenate(x) for x in zip(*found, strict=True)))
    ok = _primitive(start, end, period)
    return start[ok], end[ok], period[ok]


def _detect(rewrite: Callable[[int | None, int], np.ndarray | None] | None):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            words = words_of(common.texts_of(batch.column("text")))
            n = np.diff(words.offsets)
            source = np.arange(len(words.ids))
            if rewrite:
                for i, key in enumerate(keys):
                    if n[i] and (own := rewrite(key, int(n[i]))) is not None:
                        source[words.offsets[i] : words.offsets[i + 1]] = words.offsets[i] + own
            ids = words.ids[source]
            text = np.repeat(np.arange(len(keys)), n)
            start, end, period = runs_of(ids, text, words.offsets)
            order = np.lexsort((period, start))
            start, end, period = start[order], end[order], period[order]
            # Words of a run after its first period go.
            change = np.zeros(len(ids) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, end, -1)
            stay = np.flatnonzero(np.cumsum(change[:-1]) == 0)
            size = words.lengths[source[stay]] + 1  # and a blank
            at = np.concatenate([[0], np.cumsum(size)])
            take = np.repeat(words.starts[source[stay]] - at[:-1], size) + np.arange(at[-1])
            take[at[1:] - 1] = len(words.data)
            data = np.append(words.data, np.uint8(32))[take]
            left = np.searchsorted(stay, words.offsets)
            edges = at[left]
            texts = [data[a : max(a, b - 1)].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            first = words.offsets[text[start]] if len(start) else start
            rows = pa.StructArray.from_arrays(
                [pa.array(start - first), pa.array(end - start), pa.array(period)], names=["start", "length", "period"]
            )
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, words.offsets).astype(np.int32)), rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), lists, pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return work


def detect_runs(docs: DataFrame, rewrite: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start, then period) and collapsed, for every row.

    ``rewrite`` may say, for a doc_id and its number of words, which word stands at each place (None:
    as they are).  ``collapsed`` has the words that no run holds after its first period, with blanks
    between.  Null and empty texts have no words; repeated rows and null ids have their rows; other
    columns may have any names; an empty table gives no rows.  A text is held whole, about 200 bytes a word.
    """
    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return common.map_batches(common.id_and_text(docs), _detect(rewrite), schema)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The periodic stretch that the query puts into the texts of a tenth of the ids (none for a null id)."""
    h = common.fold(doc_id, 1 << 32)
    if doc_id is None or h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def summary(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the run with most periods, and digests of the runs and the collapsed text."""
    order = F.transform(
        "runs",
        lambda r: F.struct(
            F.floor(r["length"] / r["period"]).alias("whole"),
            ((r["length"] % r["period"]) / r["period"]).alias("rest"),
            (-r["start"]).alias("start"),
            (-r["period"]).alias("period"),
            r["length"].alias("length"),
        ),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", F.array_max(order)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
