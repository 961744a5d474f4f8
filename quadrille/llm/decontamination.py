"""Benchmark decontamination with one FM-index per training shard.

A shard is a block of documents inside an input task.  Its words become symbols of the benchmark's
vocabulary; any window lies inside a stretch of such words, so only stretches as long as the
shortest window enter the index.  The index is the Burrows-Wheeler transform of the stretches in a
wavelet matrix; windows are searched backwards through its ranks, all at once, occurrences are
located from sampled suffix positions, and overlapping ones merge into removal spans.
Documents are not shuffled, they stay where they are read.

Spark tasks cut the benchmark into windows, in parts of bounded size; each part is a file of the
shared folder that the tasks of documents read.  The driver sees the names of these files only.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of benchmark text in one part, about; a task holds some parts, each about five times that.
PHRASE_BYTES = 16 << 20
#: Windows that are searched at once.
WINDOWS = 1 << 16
#: Bytes of text in a shard.
SHARD_BYTES = 8 << 20
#: One suffix position of so many is kept.
SAMPLE = 8

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Phrases:
    """Distinct windows of benchmark items, by length, with the items that hold them.

    A window is a place in the sequence of all words' symbols.
    """

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        numbers: dict[str, int] = {}
        parts, places, at = [], {}, 0
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        for item_id, text in items:
            words = common.word_numbers((text or "").encode(), number)
            if not len(words):
                continue
            owner = numbers.setdefault("null" if item_id is None else item_id, len(numbers))
            n = min(window, len(words))
            starts = np.arange(at, at + len(words) - n + 1, dtype=np.int32)
            places.setdefault(n, []).append((starts, np.full(len(starts), owner, np.int32)))
            parts.append(words)
            at += len(words)
        self.items = list(numbers)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        #: Length, where each distinct window stands, and where its owners begin in the last array.
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n, own in sorted(places.items()):
            starts, owners = (np.concatenate(x) for x in zip(*own, strict=True))
            rows = np.ascontiguousarray(self.words[starts[:, None] + np.arange(n)])
            _, first, which = np.unique(rows.view(np.dtype((np.void, 4 * n))).ravel(), return_index=True, return_inverse=True)
            pairs = np.unique(which.astype(np.int64) * len(numbers) + owners)
            ends = np.searchsorted(pairs, np.arange(len(first) + 1) * len(numbers))
            self.groups.append((n, starts[first], ends, (pairs % len(numbers)).astype(np.int32)))
        self.shortest = min((g[0] for g in self.groups), default=0)


class WaveletMatrix:
    """Rank of symbols in a sequence: one bit plane a level, each with its running count."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, len(symbols) - int(before[-1])))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])
        every = np.arange(top + 1, dtype=np.int64)
        self.starts = self._descend(every, np.zeros(top + 1, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, before, zeros in self.levels:
            ones = before[at]
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._descend(symbol, at) - self.starts[symbol]


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Prefix doubling; each 0 is an end of its own, smaller than all symbols, first ones first."""
    n = len(sequence)
    ends = np.flatnonzero(sequence == 0)
    rank = sequence + len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2 + n) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        step *= 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class FMIndex:
    """Backward search and location over a sequence in which 0 ends each stretch."""

    def __init__(self, sequence: np.ndarray, top: int, sample: int = SAMPLE):
        order = suffix_array(sequence)
        self.bwt = sequence[order - 1]  # the row of suffix 0 gets the final 0
        self.ranks = WaveletMatrix(self.bwt, top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=top + 1))])
        kept = (order % sample == 0) | (self.bwt == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.positions = kept, order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of patterns that occur, with their ranges of suffixes."""
        alive = np.arange(len(patterns))
        last = patterns[:, -1]
        low, high = self.first[last], self.first[last + 1]
        for j in range(patterns.shape[1] - 2, -1, -1):
            stays = low < high
            alive, low, high = alive[stays], low[stays], high[stays]
            symbol = patterns[alive, j]
            low = self.first[symbol] + self.ranks.rank(symbol, low)
            high = self.first[symbol] + self.ranks.rank(symbol, high)
        stays = low < high
        return alive[stays], low[stays], high[stays]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Walks back from each row to the nearest sampled suffix."""
        steps, rows = np.zeros(len(rows), np.int64), rows.copy()
        walking = np.flatnonzero(~self.kept[rows])
        while len(walking):
            at = rows[walking]
            symbol = self.bwt[at]
            rows[walking] = self.first[symbol] + self.ranks.rank(symbol, at)
            steps[walking] += 1
            walking = walking[~self.kept[rows[walking]]]
        return self.positions[self.kept_before[rows]] + steps


def search_shard(
    texts: list[bytes], phrases: Phrases
) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """For each text: its number of words, merged spans of hit words [start, end), item names."""
    get = phrases.vocabulary.get
    parts, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        numbers = common.word_numbers(text, get)
        counts[i] = len(numbers)
        parts += [numbers, np.zeros(1, np.int32)]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    ids = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    known = np.concatenate([[0], (ids > 0).view(np.int8), [0]])
    edges = np.flatnonzero(np.diff(known))
    begins, ends = edges[::2], edges[1::2]
    long = ends - begins >= max(1, phrases.shortest)
    begins, ends = begins[long], ends[long]
    if not len(begins) or not phrases.groups:
        return counts, spans, items
    mark = np.zeros(len(ids) + 1, np.int32)
    mark[begins] += 1
    mark[ends + 1] -= 1  # the word after a stretch is unknown, or an end: its 0 closes the stretch
    place = np.flatnonzero(np.cumsum(mark)[:-1])
    index = FMIndex(ids[place], len(phrases.vocabulary))
    there = np.zeros(len(phrases.vocabulary) + 1, bool)
    there[ids[place]] = True
    cover = np.zeros(len(ids) + 1, np.int32)
    owned = []
    for length, windows, offsets, owners in phrases.groups:
        for a in range(0, len(windows), WINDOWS):
            rows = phrases.words[windows[a : a + WINDOWS, None] + np.arange(length)].astype(np.int64)
            able = np.flatnonzero(there[rows].all(axis=1))
            which, low, high = index.search(rows[able]) if len(able) else (able, able, able)
            if not len(which):
                continue
            which = able[which] + a
            n = high - low
            of = np.repeat(np.arange(len(which)), n)
            at = place[index.locate(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[of])]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            doc = np.searchsorted(starts, at, "right") - 1
            pairs = np.unique(doc * len(windows) + which[of])
            doc, window = pairs // len(windows), pairs % len(windows)
            n = offsets[window + 1] - offsets[window]
            of = np.repeat(np.arange(len(window)), n)
            held = owners[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + offsets[window][of]]
            owned.append(np.unique(doc[of] * len(phrases.items) + held))
    hit = np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).view(np.int8), [0]])
    edges = np.flatnonzero(np.diff(hit))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        doc = int(np.searchsorted(starts, a, "right")) - 1
        spans[doc].append((a - int(starts[doc]), b - int(starts[doc])))
    if owned:
        for pair in np.unique(np.concatenate(owned)).tolist():
            items[pair // len(phrases.items)].append(phrases.items[pair % len(phrases.items)])
    return counts, spans, items


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order; touching ones become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    words = [m.span() for m in _WORD.finditer(text.lower())]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return b"".join([*out, text[at:]])


_SPANS = "array<struct<start:int,stop:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _write_phrases(window: int, folder: str):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part; each part becomes a file."""
        for group in common.grouped(batches, ["part"]):
            rows = zip(group["item"].to_pylist(), group["text"].to_pylist(), strict=True)
            phrases = Phrases(rows, window)
            path = f"{folder}/{group['part'][0].as_py():06d}-{uuid.uuid4().hex}"
            common.write_file(path, pickle.dumps(phrases))
            yield pa.RecordBatch.from_pylist([{"path": path}])

    return work


def _search(paths: list[str], text_name: str, names: list[str]):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.texts_of(batch.column(text_name))
            for start, stop in common.blocks(texts, SHARD_BYTES):
                own = texts[start:stop]
                found = [search_shard(own, common.loaded(__name__, path)) for path in paths]
                counts = found[0][0] if found else np.array([len(common.alnum_words(t)) for t in own], np.int64)
                spans = [merge_spans(x for f in found for x in f[1][i]) for i in range(len(own))]
                items = [sorted({x for f in found for x in f[2][i]}) for i in range(len(own))]
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(n) for n in names),
                        pa.array(counts),
                        pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], _SPAN_TYPE),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    names=[*names, "words", "spans", "items"],
                )

    return work


def search(
    placed: DataFrame,
    text_name: str,
    benchmark: DataFrame,
    window: int = 10,
    item_col: str = "item_id",
    item_text_col: str = "text",
    phrase_bytes: int = PHRASE_BYTES,
) -> DataFrame:
    """``placed`` with ``words`` (their number), ``spans`` (merged spans of hit words), ``items`` (sorted).

    Words are maximal stretches of digits, letters a-z (A-Z lower-cased) and bytes from 0x80 on.
    A window is ``window`` consecutive words of an item, or all words of a shorter one; an item
    without words has none.  Null text has no words.  Items of a null id are named "null"; rows of
    one id are one item.  An empty table on either side gives no hits.

    A shard is searched for one part of the benchmark (about ``phrase_bytes`` of text) after the other;
    the files of parts stay in the shared folder, as the result is worked out when it is asked for.
    """
    spark = placed.sparkSession
    source, (item, text) = common.by_place(benchmark, item_col, item_text_col)
    bench = source.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // phrase_bytes))
    dealt = bench.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)).cast("long"))
    dealt = dealt.filter("text <> ''").repartition(parts, "part").sortWithinPartitions("part", "item", "text")
    files = common.map_batches(dealt, _write_phrases(window, common.new_path(spark, "benchmark-phrases")), "path string")
    paths = sorted(r.path for r in files.collect())  # one a part
    schema = common.with_columns(placed, f"words long, spans {_SPANS}, items array<string>")
    return common.map_batches(placed, _search(paths, text_name, placed.columns), schema)


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


#: Share of a document's words in hits from which on it goes without a hit of full length.
HIT_SHARE = 0.5


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, hit_share: float = HIT_SHARE, text_col: str = "text", **options
) -> DataFrame:
    """``docs`` without the documents of which ``window`` words in a row are hits, or ``hit_share`` of all; same columns.

    So shorter items take a document along only where they are much of it.  Null and empty texts stay,
    repeated rows are decided alike, other columns may have any names; empty tables on either side are
    allowed.
    """
    placed, (text,) = common.by_place(docs, text_col)
    found = search(placed, text, benchmark, window, **options)
    full = F.exists("spans", lambda s: s["stop"] - s["start"] >= window)
    much = (F.size("spans") > 0) & (hit_words() >= F.col("words") * hit_share)
    return common.as_before(found.filter(~(full | much)), docs)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted), spans, contaminated.

    Null and empty texts have no words; null ids and repeated rows have their rows.  See ``search``.
    """
    found = search(common.id_and_text(docs, id_col, text_col), "text", benchmark, window, **options)
    return found.select(
        "doc_id",
        F.col("words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        "spans",
        (F.size("spans") > 0).alias("contaminated"),
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the hit words cut out of their texts; same columns.

    Null texts stay null; a text that is all hits becomes what stands around its words.  Other columns
    may have any names.
    """
    placed, (text,) = common.by_place(docs, text_col)
    found = search(placed, text, benchmark, window, **options)
    names = placed.columns

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(text)
            spans = batch.column("spans").to_pylist()
            texts = [
                None if t is None else cut_words(t, [(s["start"], s["stop"]) for s in span]).decode()
                for t, span in zip(old.cast(pa.binary()).to_pylist(), spans, strict=True)
            ]
            arrays = [pa.array(texts, old.type) if n == text else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return common.as_before(common.map_batches(found, work, placed.schema), docs)
