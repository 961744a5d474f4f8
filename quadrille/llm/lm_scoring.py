"""LM scoring by prediction by partial matching (PPM) over bytes, beside a unigram word model.

The trie of byte contexts is counted over all training documents: tasks count (order+1)-grams of
bytes, Spark sums them, and all of them count.  A byte is coded in its longest known context; where
that has not seen it, the escape (method C: as likely as the number of distinct successors) leads to
the next shorter context, in which the symbols of the longer one are excluded.

A byte's probability depends on the (order+1)-gram that ends with it alone.  The head, grams with at
least the share ``min_share`` of all coded bytes (so at most about 1/min_share), is broadcast with
its probabilities.  The other grams of each document meet the counts of training in the task of
their last two context bytes: all counts that code a gram share these, but for those of contexts of
one byte and none, which are broadcast.  Lookups run over whole blocks in numpy.

Word counts for the base score are summed by Spark over all training words.  Words above a share of
all tokens (bounded in number and length) are broadcast; the others of each document are joined
with the table of counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 4
MIN_SHARE = 2.0**-20
#: Levels of so many shortest contexts are broadcast whole: at most 2^16 grams.
SMALL_LEVELS = 2
#: Rows of grams that a task of the tail looks up at once.
TAIL_ROWS = 1_000_000
#: Words with a larger share of all tokens than this and at most so many bytes are broadcast.
FREQUENT_SHARE, FREQUENT_BYTES = 2.0**-19, 64
BLOCK_BYTES = 2 << 20
COUNT_BYTES = 16 << 20
#: Different grams that a task holds before it hands its counts on.
MOST_GRAMS = 1_000_000

#: Never part of UTF-8: ends a document, and fills the context before its first byte.
END = b"\xff"
#: Stands for the end token among words; no word contains a blank.
END_WORD = " "


class Table:
    """Finds positions of 64-bit keys: a direct-mapped part for most, sorted search for the rest."""

    def __init__(self, keys: np.ndarray, weight: np.ndarray):
        self.n = len(keys)
        self.bits = np.uint64(64 - max(4, int(2 * self.n).bit_length() + 1))
        self.slot_key = np.full(1 << (64 - int(self.bits)), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
        self.slot_at = np.full(len(self.slot_key), -1, np.int32)
        order = np.argsort(-weight, kind="stable")
        slots, first = np.unique(self._slot(keys[order]), return_index=True)
        self.slot_key[slots], self.slot_at[slots] = keys[order[first]], order[first]
        rest = np.ones(self.n, bool)
        rest[order[first]] = False
        self.rest_at = np.flatnonzero(rest).astype(np.int32)
        self.rest_at = self.rest_at[np.argsort(keys[self.rest_at])]
        self.rest_key = keys[self.rest_at]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is not there."""
        slot = self._slot(keys)
        at = np.where(self.slot_key[slot] == keys, self.slot_at[slot], -1)
        if len(self.rest_key):
            lost = np.flatnonzero(at < 0)
            wanted = keys[lost]
            near = np.minimum(np.searchsorted(self.rest_key, wanted), len(self.rest_key) - 1)
            at[lost] = np.where(self.rest_key[near] == wanted, self.rest_at[near], -1)
        return at


@dataclass
class Level:
    """Contexts of one length: successors (grams) with counts, and per context total, number of
    distinct successors, and how often its successors follow the next shorter context."""

    grams: Table
    counts: np.ndarray
    contexts: Table
    totals: np.ndarray
    kinds: np.ndarray
    shorter: np.ndarray


@dataclass
class Trie:
    levels: list[Level]  # by context length

    @property
    def order(self) -> int:
        return len(self.levels) - 1


def _mask(order: int) -> int:
    return (1 << (8 * (order + 1))) - 1


def build_trie(grams: list[tuple[np.ndarray, np.ndarray]], shorter: Iterable[Level] = ()) -> Trie:
    """Keys of (k+1)-grams (last byte lowest) and their counts, for each k from that after ``shorter`` on."""
    levels = list(shorter)
    for k, (keys, counts) in enumerate(grams, len(levels)):
        keys, counts = keys.astype(np.uint64), counts.astype(np.float64)
        contexts, place = np.unique(keys >> np.uint64(8), return_inverse=True)
        totals = np.bincount(place, counts, len(contexts))
        kinds = np.bincount(place, minlength=len(contexts)).astype(np.float64)
        shorter = np.zeros(len(contexts))
        if k and len(keys):
            below = levels[k - 1]
            at = below.grams.find(keys & np.uint64(_mask(k - 1)))
            shorter = np.bincount(place, np.where(at >= 0, below.counts[at], 0.0), len(contexts))
        levels.append(Level(Table(keys, counts), counts, Table(contexts, totals), totals, kinds, shorter))
    return Trie(levels)


def _chunks(texts: list[bytes], order: int, most: int) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of (number of a text, bytes of it after ``order`` bytes of context) of about ``most`` bytes.

    Coded are the bytes of each text and its end; the context before them is filled with ends.  A text
    of more bytes is cut, and its later chunks begin with what stands before them.
    """
    held, size = [], 0
    for i, text in enumerate(texts):
        for a in range(0, len(text) + 1, most):
            chunk = text[max(0, a - order) : a + most]
            if a < order:
                chunk = END * (order - a) + chunk
            if a + most > len(text):
                chunk += END
            if held and size + len(chunk) > most:
                yield held
                held, size = [], 0
            held.append((i, chunk))
            size += len(chunk)
    if held:
        yield held


def _coded(chunks: list[tuple[int, bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of the (order+1)-gram that ends at each coded place of some chunks; where each chunk's begin."""
    data = np.frombuffer(b"".join(c for _, c in chunks), np.uint8)
    lengths = np.array([len(c) - order for _, c in chunks], np.int64)
    keys = np.zeros(max(0, len(data) - order), np.uint64)
    for j in range(order + 1):
        keys = (keys << np.uint64(8)) | data[j : len(data) - order + j]
    starts = np.cumsum(lengths) - lengths
    # The context at the start of a later chunk is no place of its own.
    place = np.arange(int(lengths.sum())) + np.repeat(order * np.arange(len(chunks)), lengths)
    return keys[place], starts


def log_probabilities(keys: np.ndarray, trie: Trie) -> np.ndarray:
    """Natural log-probability of the last byte of each (order+1)-gram given those before it."""
    out = np.zeros(len(keys))
    todo = np.arange(len(keys))
    gone_total, gone_kinds = np.zeros(len(keys)), np.zeros(len(keys))
    for k in range(trie.order, -1, -1):
        if not len(todo):
            return out
        level = trie.levels[k]
        gram = keys[todo] & np.uint64(_mask(k))
        at = level.grams.find(gram)
        context = level.contexts.find(gram >> np.uint64(8))
        known = context >= 0
        kinds = np.where(known, level.kinds[context] - gone_kinds[todo], 0) if level.contexts.n else np.zeros(len(todo))
        total = (
            np.where(known, level.totals[context] - gone_total[todo] + kinds, 0) if level.contexts.n else np.zeros(len(todo))
        )
        hit = at >= 0
        out[todo[hit]] += np.log(level.counts[at[hit]] / total[hit])
        escapes = ~hit & known & (kinds > 0) & (total > kinds)
        out[todo[escapes]] += np.log(kinds[escapes] / total[escapes])
        seen = todo[~hit & known]
        if len(seen):
            gone_total[seen] = level.shorter[context[~hit & known]]
            gone_kinds[seen] = level.kinds[context[~hit & known]]
        todo = todo[~hit]
    out[todo] -= np.log(256 - gone_kinds[todo])  # equally likely among bytes never seen
    return out


@dataclass
class Head:
    """The commonest (order+1)-grams with their natural log-probabilities; the last one is 0."""

    grams: Table
    logs: np.ndarray
    order: int


_TAIL = pa.struct([("gram", pa.int64()), ("n", pa.int32())])


def score_head(texts: list[bytes], head: Head) -> tuple[np.ndarray, pa.Array]:
    """log10 probability of the places of each text (and its end) that the head codes; the grams of
    the others with how often they stand in the text (a gram may come again in a long one)."""
    out, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    grams, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for chunks in _chunks(texts, head.order, BLOCK_BYTES):
        keys, starts = _coded(chunks, head.order)
        of = np.array([i for i, _ in chunks])
        at = head.grams.find(keys)
        np.add.at(out, of, np.add.reduceat(head.logs[at], starts))
        lost = np.flatnonzero(at < 0)
        text, gram = of[np.searchsorted(starts, lost, "right") - 1], keys[lost]
        order = np.lexsort((gram, text))
        text, gram = text[order], gram[order]
        new = np.ones(len(gram), bool)
        new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
        first = np.flatnonzero(new)
        grams.append(gram[first])
        times.append(np.diff(np.append(first, len(gram))))
        sizes += np.bincount(text[first], minlength=len(texts))
    pairs = [pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(times).astype(np.int32))]
    ends = np.concatenate([[0], sizes]).cumsum().astype(np.int32)
    return out / np.log(10), pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(pairs, fields=list(_TAIL)))


def _tail_scores(uid: np.ndarray, gram: np.ndarray, n: np.ndarray, small: list[Level], order: int):
    """Uids and the sums of log10 probabilities of their grams, learnt from the rows of negative uid."""
    learnt = uid < 0
    keys, counts = gram[learnt], n[learnt]
    longer = [_merge(keys & np.uint64(_mask(k)), counts) for k in range(len(small), order + 1)]
    logs = log_probabilities(gram[~learnt], build_trie(longer, small)) * n[~learnt]
    uids, place = np.unique(uid[~learnt], return_inverse=True)
    return uids, np.bincount(place, logs, len(uids)) / np.log(10)


def _score_tail(small, order: int, most: int = TAIL_ROWS):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by the last two bytes of their context, within these those of training first.

        So a document's row always finds all it needs before it; what later rows may need are the
        training rows of the last context alone.
        """
        held: list[tuple[np.ndarray, ...]] = []
        rows, wait = 0, most

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, wait
            uid, gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
            if (uid >= 0).any():
                uids, sums = _tail_scores(uid, gram, n, small.value, order)
                for i in range(0, len(uids), 1 << 17):
                    j = slice(i, i + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array(uids[j]), pa.array(sums[j])], names=["uid", "more_score"])
            end = _end_of_context(gram)
            stay = (uid < 0) & (end == end[-1])
            held, rows = [(uid[stay], gram[stay], n[stay])], int(stay.sum())
            wait = max(most, 2 * rows)

        for batch in batches:
            columns = (batch.column(x).to_numpy() for x in ("uid", "gram", "n"))
            uid, gram, n = columns
            held.append((uid, gram.view(np.uint64), n))
            rows += len(uid)
            if rows >= wait:
                yield from out()
        if rows:
            yield from out()

    return work


def _end_of_context(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(8)) & np.uint64(0xFFFF)


def adaptive_code_length(text: bytes, order: int = ORDER) -> float:
    """Bits of one text under PPM that learns from the text alone as it goes (order-0 start: 256 bytes)."""
    counts: dict[bytes, Counter] = {}
    data, bits = text + END, 0.0
    for i in range(len(data)):
        symbol, excluded = data[i], set()
        for k in range(min(order, i), -1, -1):
            seen = counts.get(data[i - k : i])
            if not seen:
                continue
            live = {s: n for s, n in seen.items() if s not in excluded}
            total = sum(live.values()) + len(live)
            if symbol in live:
                bits -= np.log2(live[symbol] / total)
                break
            if live:
                bits -= np.log2(len(live) / total)
            excluded |= seen.keys()
        else:
            bits += np.log2(256 - len(excluded))
        for k in range(min(order, i) + 1):
            counts.setdefault(data[i - k : i], Counter())[symbol] += 1
    return float(bits)


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def _count_grams(order: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts over the task, handed on when there are many different grams."""
        total = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(total[0]), 1 << 17):
                j = slice(i, i + (1 << 17))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(total[0][j].view(np.int64)), pa.array(total[1][j])], names=["gram", "n"]
                )

        for batch in batches:
            texts = [t.lower() for t in common.texts_of(batch.column("text"))]
            for chunks in _chunks(texts, order, BLOCK_BYTES):
                keys, counts = np.unique(_coded(chunks, order)[0], return_counts=True)
                total = _merge(np.concatenate([total[0], keys]), np.concatenate([total[1], counts]))
                if len(total[0]) > MOST_GRAMS:
                    yield from out()
                    total = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield from out()

    return work


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        numbers = pa.array(list(counts.values()), pa.int64())
        for i in range(0, len(words), 1 << 17):
            yield pa.RecordBatch.from_arrays([words.slice(i, 1 << 17), numbers.slice(i, 1 << 17)], names=["word", "n"])

    for batch in batches:
        for text in common.texts_of(batch.column("text")):
            counts[END_WORD.encode()] += 1
            for part in common.blank_parts(text):
                counts.update(common.blank_words(part))
                size += len(part)
                if size > COUNT_BYTES:
                    yield from out()
                    counts, size = Counter(), 0
    if counts:
        yield from out()


@dataclass
class WordModel:
    """Token and vocabulary totals, counts of frequent words, and the table of all counts."""

    total: int
    distinct: int
    frequent: dict[bytes, int]
    table: DataFrame


def train_words(train: DataFrame, ws: common.Workspace, share: float = FREQUENT_SHARE) -> WordModel:
    table = ws.written(
        common.map_batches(train.select("text"), _count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")),
        "word-counts",
    )
    row = table.agg(F.sum("n").alias("n"), F.count("word").alias("v")).first()
    total = row.n or 0
    often = table.filter((F.col("n") > int(total * share)) & (F.octet_length("word") <= FREQUENT_BYTES)).toPandas()
    frequent = dict(zip((w.encode() for w in often.word), often.n.tolist(), strict=True))
    return WordModel(total, row.v, frequent, table)


@dataclass
class GramModel:
    """The head, the levels of the shortest contexts, and the table of all counts."""

    head: Head
    small: list[Level]
    table: DataFrame


def _pairs(frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = frame.toArrow()
    return rows.column("gram").to_numpy().astype(np.uint64), rows.column("n").to_numpy().astype(np.float64)


def train_grams(train: DataFrame, ws: common.Workspace, order: int = ORDER, min_share: float = MIN_SHARE) -> GramModel:
    grams = ws.written(
        common.map_batches(train.select("text"), _count_grams(order), "gram long, n long")
        .groupBy("gram")
        .agg(F.sum("n").alias("n")),
        "byte-grams",
    )
    short = [
        _pairs(grams.groupBy(F.col("gram").bitwiseAND(F.lit(_mask(k)).cast("long")).alias("gram")).agg(F.sum("n").alias("n")))
        for k in range(min(SMALL_LEVELS, order + 1))
    ]
    least = max(1, int(short[0][1].sum() * min_share))
    keys, counts = _pairs(grams.filter(F.col("n") >= least))
    contexts = (
        grams.groupBy(F.shiftright("gram", 8).alias("gram"))
        .agg(F.sum("n").alias("total"), (F.sum("n") + F.count("n")).alias("n"))
        .filter(F.col("total") >= least)
    )
    known, shares = _pairs(contexts)
    ascending = np.argsort(known)
    known, shares = known[ascending], shares[ascending]
    logs = np.log(counts / shares[np.searchsorted(known, keys >> np.uint64(8))]) if len(keys) else counts
    return GramModel(Head(Table(keys, counts), np.append(logs, 0.0), order), build_trie(short).levels, grams)


#: Tasks that the tail's grams are dealt to.  A document gets a sum from each task that holds a gram of it, so a
#: number that grew with the input would let the sums grow faster than the documents.
TAIL_TASKS = 128


def tail_scores(scored: DataFrame, model: GramModel) -> DataFrame:
    """uid, more_score: log10 probabilities of grams of ``tail``, in sums of which a uid may have several."""
    rows = model.table.select(F.lit(-1).cast("long").alias("uid"), "gram", "n").union(
        scored.select("uid", F.inline("tail")).select("uid", "gram", F.col("n").cast("long"))
    )
    rows = rows.withColumn("end", F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF).cast("long")))
    rows = rows.repartition(TAIL_TASKS, "end").sortWithinPartitions("end", "uid").drop("end")
    small = scored.sparkSession.sparkContext.broadcast(model.small)
    return common.map_batches(rows, _score_tail(small, model.head.order), "uid long, more_score double")


_SCHEMA = (
    "uid long, main boolean, doc_id long, n_tokens long, n_known long, base double, score double, rare array<string>, "
    "times array<int>, tail array<struct<gram:long,n:int>>"
)
#: Rare words, and grams of the tail, of one row; a document with more of them has several rows.
ROW_ENTRIES = 1 << 18


def _words_of(text: bytes, logs: dict[bytes, float], end: bytes) -> tuple[int, int, float, Counter]:
    """Tokens of a text, frequent ones among them, the sum of their logs, and the others."""
    tokens = known = 0
    base, rest = 0.0, Counter()
    for part in common.blank_parts(text + b" "):
        words = part.split()
        tokens += len(words)
        gained = list(filter(None, map(logs.get, words)))
        known += len(gained)
        base += sum(gained)
        if len(gained) < len(words):
            rest.update(w for w in words if w not in logs)
    if end in logs:
        return tokens + 1, known + 1, base + logs[end], rest
    rest[end] += 1
    return tokens + 1, known, base, rest


def _score(head, frequent):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = common.partition_id() << 36
        logs = {w: float(np.log10(n + 1)) for w, n in frequent.value.items()}
        end = END_WORD.encode()
        for batch in batches:
            texts = [t.lower() for t in common.texts_of(batch.column("text"))]
            for a, b in common.blocks(texts, BLOCK_BYTES * 4):
                n = b - a
                tokens, known, base, rest = zip(*(_words_of(t, logs, end) for t in texts[a:b]), strict=True)
                scores, tail = score_head(texts[a:b], head.value)
                long = [i for i in range(n) if max(len(rest[i]), len(tail[i])) > ROW_ENTRIES]
                cut = [Counter() if i in long else r for i, r in enumerate(rest)] if long else rest
                if long:
                    keep = pa.array([i not in long for i in range(n)])
                    own, tail = tail, pc.if_else(keep, tail, pa.scalar([], tail.type))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(uid, uid + n)),
                        pa.array([True] * n),
                        batch.column("doc_id").slice(a, n),
                        pa.array(tokens, pa.int64()),
                        pa.array(known, pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(scores),
                        pa.array([list(r) for r in cut], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                        pa.array([list(r.values()) for r in cut], pa.list_(pa.int32())),
                        tail,
                    ],
                    names=_SCHEMA_NAMES,
                )
                for i in long:
                    words, times, grams = list(rest[i]), list(rest[i].values()), own[i].values
                    for k in range(0, max(len(words), len(grams)), ROW_ENTRIES):
                        j = slice(k, k + ROW_ENTRIES)
                        row = [uid + i, False, None, 0, 0, 0.0, 0.0, [w.decode() for w in words[j]], times[j]]
                        part = pa.ListArray.from_arrays([0, len(grams[j])], grams[j])
                        types = [f.type for f in _ARROW][: len(row)]
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array([x], t) for x, t in zip(row, types, strict=True)), part], names=_SCHEMA_NAMES
                        )
                uid += n

    return work


_ARROW = pa.schema(
    [
        ("uid", pa.int64()),
        ("main", pa.bool_()),
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base", pa.float64()),
        ("score", pa.float64()),
        ("rare", pa.list_(pa.string())),
        ("times", pa.list_(pa.int32())),
        ("tail", pa.list_(_TAIL)),
    ]
)
_SCHEMA_NAMES = _ARROW.names


def score_documents(
    docs: DataFrame,
    train: DataFrame | None = None,
    held_out: Column | None = None,
    order: int = ORDER,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from ``train`` (default: the rows of ``docs`` that are not held out, fold 2 of 7).  Null
    text counts as empty and has the end token alone.  Repeated rows count and are scored as often
    as they stand.  Long texts are coded in chunks, with the context before them.  ``min_share`` sets
    what is broadcast, not what is known.  With nothing to learn from, every byte has probability 1/256
    and base_score is 0.  Other columns may have any names.  An empty table gives no rows.
    """
    rows = common.id_and_text(docs)
    out_of_it = common.fold_column(F.col("doc_id"), 7) == 2 if held_out is None else held_out
    train = rows.filter(~out_of_it) if train is None else common.by_place(train, "text")[0].select(
        F.col(common.by_place(train, "text")[1][0]).alias("text")
    )
    with common.Workspace(docs.sparkSession, "lm-scoring") as ws:
        return ws.result(_scored(rows, train, out_of_it, order, min_share, ws))


def _scored(rows: DataFrame, train: DataFrame, out_of_it: Column, order: int, min_share: float, ws: common.Workspace) -> DataFrame:
    words, grams = train_words(train, ws), train_grams(train, ws, order, min_share)
    context = rows.sparkSession.sparkContext
    head, frequent = context.broadcast(grams.head), context.broadcast(words.frequent)
    scored = ws.written(common.map_batches(rows, _score(head, frequent), _SCHEMA), "lm-scores")
    rest = (
        scored.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r"))
        .select("uid", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
        .join(words.table, "word")
        .select(
            "uid",
            (F.col("times") * F.log10(F.col("n") + 1)).alias("more_base"),
            F.col("times").cast("long").alias("more_known"),
            F.lit(0.0).alias("more_score"),
        )
        .union(
            tail_scores(scored, grams).select("uid", F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("k"), "more_score")
        )
        .groupBy("uid")
        .agg(*(F.sum(c).alias(c) for c in ("more_base", "more_known", "more_score")))
    )
    size = float(np.log10(words.total + words.distinct + 1))
    return scored.filter("main").drop("main", "rare", "times", "tail").join(rest, "uid", "left").select(
        "doc_id",
        out_of_it.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(size)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
