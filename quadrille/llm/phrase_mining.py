"""Phrase collocation mining over a prefix-free parse.

Tasks cut pieces of text into chunks where the hash of a window of words says so; a chunk reaches
as many words into the next one as the longest phrase has less one, so each occurrence of a phrase
stands in the chunk that owns its first word, once.  Distinct chunks and how often they occur form
the dictionary table.  Phrases are counted in it, weighted, a length at a time: only phrases whose
parts without the first and without the last word are frequent can be frequent, and a bit filter
of bounded size tells most of those without asking a table.  What passes is counted exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words of the longest phrase; chunks overlap by one less.
MOST_WORDS = 5
#: One window of words in so many begins a chunk; no chunk owns more than LONGEST words.
TRIGGER, LONGEST = 16, 256
#: Bits of the filter: 16 a frequent phrase, at most 2^29 (64 MB), which lets more pass but drops none.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 29
_BLOCK = 1 << 16  # bits of a filter's row

_SEPARATORS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Lower-cases A-Z, turns what ends a piece into a line feed and what ends a word into a blank.
_TABLE = bytes(
    10 if b in _SEPARATORS else 32 if b in _BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_WORD = np.array([b not in (10, 32) for b in range(256)], np.uint8)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A string array of slices of ``data``, which may overlap."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at])]
    return pa.Array.from_buffers(pa.large_string(), len(lengths), buffers).cast(pa.string())


def _cuts(hashes: np.ndarray, piece: np.ndarray, span: int) -> np.ndarray:
    """Where chunks begin: at each piece, where a window's hash triggers, and after LONGEST words."""
    n = len(hashes)
    begins = np.ones(n, bool)
    begins[1:] = piece[1:] != piece[:-1]
    if n >= span:
        window = hashes[: n - span + 1].copy()
        for k in range(1, span):
            window = window * _STEP + hashes[k : n - span + 1 + k]
        whole = piece[: n - span + 1] == piece[span - 1 :]
        begins[: n - span + 1] |= whole & (common.mix64(window) % np.uint64(TRIGGER) == 0)
    starts = np.flatnonzero(begins)
    gaps = np.diff(np.append(starts, n))
    more = (gaps - 1) // LONGEST
    steps = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    return np.sort(np.concatenate([starts, np.repeat(starts, more) + steps * LONGEST]))


def chunks(texts: list[bytes], most_words: int = MOST_WORDS) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The chunks of texts (words joined by blanks), how many words each owns, and whose they are."""
    t = common.hash_tokens([x.translate(_TABLE) for x in texts], _WORD)
    if not len(t.hashes):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.searchsorted(t.offsets, np.arange(len(t.hashes)), "right") - 1
    breaks = np.cumsum(t.data == 10)
    piece = breaks[t.starts] + text  # both only grow, so equal sums have equal parts
    begins = _cuts(t.hashes, piece, max(1, most_words - 1))
    ends = np.append(begins[1:], len(piece))
    last = np.searchsorted(piece, piece[begins], "right")  # where the piece ends
    reach = np.minimum(ends + most_words - 1, last)
    # Words and one byte after each, which becomes a blank: words of a chunk are then one slice.
    inside = np.zeros(len(t.data) + 1, np.int8)
    inside[t.starts] += 1
    np.add.at(inside, t.starts + t.lengths + 1, -1)
    after = t.starts + t.lengths
    data = t.data.copy()
    data[after] = 32
    data = data[np.cumsum(inside[:-1]) > 0]
    places = np.concatenate([[0], np.cumsum(t.lengths + 1)])
    return _gather(data, places[begins], places[reach] - 1 - places[begins]), ends - begins, text[begins]


def _parse(most_words: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, owned, of = chunks(common.texts_of(batch.column("text")), most_words)
            langs = batch.column("lang").take(pa.array(of))
            yield pa.RecordBatch.from_arrays([langs, texts, pa.array(owned.astype(np.int32))], names=["lang", "chunk", "owned"])

    return work


def dictionary(docs: DataFrame, most_words: int = MOST_WORDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, chunk, owned (words whose phrases are counted here), times: the distinct chunks of the parse."""
    placed, (text, lang) = common.by_place(docs, text_col, lang_col)
    rows = placed.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")
    )
    parsed = common.map_batches(rows, _parse(most_words), "lang string, chunk string, owned int")
    return parsed.groupBy("lang", "chunk", "owned").agg(F.count("*").alias("times"))


def _phrase_hashes(texts: list[bytes], langs: list[str], n: int) -> tuple[common.Tokens, np.ndarray]:
    """Tokens, and for each the hash of the ``n`` words from it on (of any text; ends are the caller's)."""
    t = common.hash_tokens(texts, _WORD)
    salt = np.array([zlib.crc32(x.encode()) for x in langs], np.uint64)
    found = t.hashes ^ common.mix64(np.repeat(salt, np.diff(t.offsets)))
    for k in range(1, n):
        found = common.mix64(found * _STEP + np.append(t.hashes[k:], np.zeros(min(k, len(t.hashes)), np.uint64)))
    return t, found


def _bits(n: int, size: int):
    """Rows of a filter (block, 8 KB of bits) for phrases of ``n`` words."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, found = _phrase_hashes(common.texts_of(batch.column("phrase")), batch.column("lang").to_pylist(), n)
            at = np.unique(found[t.offsets[:-1]] % np.uint64(size)).astype(np.int64)
            blocks = np.unique(at // _BLOCK)
            rows = np.zeros((len(blocks), _BLOCK), bool)
            rows[np.searchsorted(blocks, at // _BLOCK), at % _BLOCK] = True
            packed = [x.tobytes() for x in np.packbits(rows, axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(packed, pa.binary())], names=["block", "bits"])

    return work


def _union(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, bits in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            own = np.frombuffer(bits, np.uint8)
            held[block] = held[block] | own if block in held else own
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["block", "bits"]
        )


def phrase_filter(frequent: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """Bits in which each frequent phrase of ``n`` words has its place set, of a bounded size."""
    size = _BLOCK
    wanted = frequent.count() * FILTER_BITS
    while size < min(wanted, MOST_FILTER_BITS):
        size *= 2
    parts = common.map_batches(frequent.select("lang", "phrase"), _bits(n, size), "block long, bits binary", 1 << 20)
    blocks = size // _BLOCK
    merged = common.map_batches(parts.repartition(min(blocks, 64), "block"), _union, "block long, bits binary")
    bits = np.zeros(size // 8, np.uint8)
    for row in merged.toLocalIterator():  # ``size`` bits in all
        bits[row.block * (_BLOCK // 8) : (row.block + 1) * (_BLOCK // 8)] = np.frombuffer(row.bits, np.uint8)
    return size, bits


def _passing(n: int, size: int, shared):
    """Phrases of ``n`` words that chunks own and whose two parts of one word less pass the filter."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            texts = common.texts_of(batch.column("chunk"))
            t, found = _phrase_hashes(texts, batch.column("lang").to_pylist(), n - 1)
            at = found % np.uint64(size)
            passes = bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1
            row = np.repeat(np.arange(len(texts)), np.diff(t.offsets))
            first = np.arange(len(row)) - t.offsets[row]
            inside = (first < batch.column("owned").to_numpy()[row]) & (first + n <= np.diff(t.offsets)[row])
            i = np.flatnonzero(inside & (passes > 0) & (np.append(passes[1:], 0) > 0))
            for a in range(0, len(i), 1 << 17):
                j = i[a : a + (1 << 17)]
                end = j + n - 1
                phrases = _gather(t.data, t.starts[j], t.starts[end] + t.lengths[end] - t.starts[j])
                whose = pa.array(row[j])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").take(whose), phrases, batch.column("times").take(whose)], names=["lang", "phrase", "times"]
                )

    return work


def frequent_phrases(space: common.Workspace, chunk_table: DataFrame, least: int, most_words: int) -> DataFrame:
    """lang, phrase, words, f: every phrase of 1 to ``most_words`` words with ``least`` occurrences or more."""
    spark = chunk_table.sparkSession
    words = F.explode(F.slice(F.split("chunk", " "), F.lit(1), F.col("owned"))).alias("phrase")
    counts = chunk_table.select("lang", "times", words)
    found = []
    for n in range(1, most_words + 1):
        if n > 1:
            size, bits = phrase_filter(found[-1], n - 1)
            shared = spark.sparkContext.broadcast(bits)
            counts = common.map_batches(chunk_table, _passing(n, size, shared), "lang string, phrase string, times long")
        kept = counts.groupBy("lang", "phrase").agg(F.sum("times").alias("f")).filter(F.col("f") >= least)
        found.append(space.written(kept.select("lang", "phrase", F.lit(n).alias("words"), "f"), f"phrases-{n}"))
        if n > 1:
            shared.destroy()
    out = found[0]
    for table in found[1:]:
        out = out.unionByName(table)
    return out


#: Whole decimals: products need more than 64 bits.
_SCORE = """(cast(a as decimal(18,0)) * cast(1000 as decimal(4,0)) * cast(n as decimal(15,0)))
            div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"""


def _parts(words: Column, least: int, most: Column) -> Column:
    """All contiguous parts of ``least`` to ``most`` words, joined by blanks."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(least), most),
            lambda m: F.transform(F.sequence(F.lit(1), F.size(words) - m + 1), lambda i: F.array_join(F.slice(words, i, m), " ")),
        )
    )


def mine(
    docs: DataFrame, least: int = 100, top: int = 2000, percent: int = 100, most_words: int = MOST_WORDS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to ``most_words`` words of each lang.

    ``a`` occurrences, ``l`` and ``r`` those of the two parts of the lowest-scoring cut, ``n`` words in
    all of the lang.  A phrase of fewer than ``least`` occurrences is none; one inside a longer phrase
    with at least ``percent`` % of its occurrences goes.  Null text has no words, null lang is ``und``;
    repeated rows count as often as they stand there.  An empty table gives no rows.  Long texts
    become many chunks; a word is one value, whatever its length.
    """
    with common.Workspace(docs.sparkSession, "phrases") as space:
        table = space.written(dictionary(docs, most_words), "dictionary")
        known = space.written(frequent_phrases(space, table, least, most_words), "frequent")
        total = table.groupBy("lang").agg(F.sum(F.col("owned") * F.col("times")).alias("n"))
        phrases = known.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
        cut = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
            "lang",
            "phrase",
            "a",
            "k",
            F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
            F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"),
        )
        lefts = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
        rights = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
        scored = (
            cut.join(lefts, ["lang", "left"])
            .join(rights, ["lang", "right"])
            .join(F.broadcast(total), "lang")  # a row a lang
            .withColumn("score", F.expr(_SCORE))
            .groupBy("lang", "phrase", "a", "n")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
        )
        inner = (
            phrases.filter(F.size("w") > 2)
            .select("lang", F.col("a").alias("f"), F.explode(_parts(F.col("w"), 2, F.size("w") - 1)).alias("phrase"))
            .groupBy("lang", "phrase")
            .agg(F.max("f").alias("f"))
        )
        stay = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("f").isNull() | (100 * F.col("f") < percent * F.col("a")))
        order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
        ranked = stay.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
        return space.result(ranked.select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score"))
