"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal.

Words and runs of punctuation are tokens; features are hashed unigrams and bigrams plus a shape
token (kind, capitals, length), and a token that repeats the one before counts as "same".  The
model is learnt from a bounded sample of labelled rows: Spark draws and orders them, and one task runs
follow-the-regularised-leader over them, the same way at any size.  Scores are sparse dot products.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the model is fitted on, about (rows are drawn by hash).
SAMPLE_ROWS = 20_000
BUCKET_BITS = 17
EPOCHS = 8
ALPHA, BETA, L1, L2 = 0.2, 0.1, 1e-4, 1e-4
BLOCK_BYTES = 2 << 20

#: Byte classes: 0 blank or control, 1 letters, digits and bytes from 0x80 on, 2 punctuation.
CLASSES = np.array(
    [1 if chr(b).isalnum() or b >= 128 else 2 if 33 <= b <= 126 else 0 for b in range(256)], np.uint8
)
_CAPITAL = np.array([65 <= b <= 90 or b >= 128 for b in range(256)], np.uint8)
_SAME = np.uint64(0x5A3E)


#: Tokens whose features are held at once.
BLOCK_TOKENS = 1 << 17


def _features_of(t: common.Tokens, a: int, b: int) -> np.ndarray:
    """A row of three buckets for each token from ``a`` to before ``b``: word, shape, pair."""
    inner = np.ones(b - a, bool)  # has a token before it in the same text
    heads = t.offsets[(t.offsets >= a) & (t.offsets < b)]
    inner[heads - a] = False
    word, before = t.hashes[a:b].copy(), t.hashes[max(0, a - 1) : b - 1]
    before = before if a else np.concatenate([[np.uint64(0)], before])
    same = inner & (word == before)
    word[same] = _SAME
    # The token before a block: it counts as "same" if it repeats the one before it.
    left = np.concatenate([[_SAME if a > 1 and a - 1 not in t.offsets and t.hashes[a - 1] == t.hashes[a - 2] else before[0]], word[:-1]])
    starts, lengths = t.starts[a:b], t.lengths[a:b]
    edges = np.stack([starts, starts + lengths], axis=1).ravel() - starts[0]
    data = t.data[starts[0] : starts[-1] + lengths[-1] + 1]
    capitals = np.minimum.reduceat(_CAPITAL[data], edges)[::2]
    shape = np.minimum(lengths, 20).astype(np.uint64) * np.uint64(8) + capitals * np.uint64(4)
    shape += CLASSES[t.data[starts]]
    kinds = np.stack(
        [
            common.mix64(word + np.uint64(1)),
            common.mix64(shape + np.uint64(0x51A9E)),
            np.where(inner, common.mix64(left * np.uint64(3) + word), common.mix64(word + np.uint64(7))),
        ],
        axis=1,
    )
    return (kinds >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the features of some tokens (rows of three) and the numbers of their texts, in order."""
    t = common.hash_tokens(texts, CLASSES)
    for a in range(0, len(t.hashes), BLOCK_TOKENS):
        b = min(a + BLOCK_TOKENS, len(t.hashes))
        yield _features_of(t, a, b), np.searchsorted(t.offsets, np.arange(a, b), "right") - 1


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the bias) after FTRL-proximal updates over (buckets, values, label)."""
    size = (1 << BUCKET_BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(at):
        zi = z[at]
        step = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, step)

    for _ in range(epochs):
        for at, x, y in rows:
            w = weight(at)
            g = (_sigmoid(w @ x) - y) * x
            square = g * g
            z[at] += g - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / ALPHA * w
            n[at] += square
    return weight(np.arange(size))


def vectors(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse vectors of texts: shares of their features, ten in all, and 1 for the bias."""
    size = 1 << BUCKET_BITS
    parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    for buckets, of in features(texts):
        keys, counts = np.unique(buckets + (of * size)[:, None], return_counts=True)
        cut = np.searchsorted(keys, np.arange(of[0], of[-1] + 2) * size)
        for i, a, b in zip(range(of[0], of[-1] + 1), cut, cut[1:], strict=False):
            parts[i].append((keys[a:b] % size, counts[a:b]))
    out = []
    for own in parts:
        at = np.concatenate([k for k, _ in own]) if own else np.zeros(0, np.int64)
        count = np.concatenate([c for _, c in own]) if own else np.zeros(0, np.int64)
        if len(own) > 1:
            at, place = np.unique(at, return_inverse=True)
            count = np.bincount(place, count)
        out.append((np.append(at, size).astype(np.int32), np.append(count * 10 / max(1, count.sum()), 1.0).astype(np.float32)))
    return out


def _learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        labels = batch.column("quality").to_pylist()
        texts = common.texts_of(batch.column("text"))
        for a, b in common.blocks(texts, BLOCK_BYTES):
            rows += [(*v, y) for v, y in zip(vectors(texts[a:b]), labels[a:b], strict=True)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([ftrl(rows).astype("<f4").tobytes()], pa.binary())], names=["weights"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on rows of ``labels`` outside fold 0 of 5 whose doc_id is in ``docs``.

    Null ids and labels are left out; a doc_id with several labels counts once for each.  About
    ``sample_rows`` rows are drawn by a hash of doc_id.  With none the model is 0: every score is 0.5.
    """
    placed, (key, quality) = common.by_place(labels, "doc_id", "quality")
    usable = placed.select(F.col(key).cast("long").alias("doc_id"), F.col(quality).cast("int").alias("quality")).filter(
        F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (common.fold_column(F.col("doc_id"), 5) != 0)
    )
    drawn = usable.filter(common.drawn(F.col("doc_id"), sample_rows, usable.count()))
    rows = (
        common.id_and_text(docs)
        .join(F.broadcast(drawn), "doc_id")  # bounded by sample_rows
        .repartition(1)
        .sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "quality", "text")
        .select("text", "quality")
    )
    found = common.map_batches(rows, _learn, "weights binary").collect()  # one row at most
    weights = np.frombuffer(found[0].weights, "<f4") if found else np.zeros((1 << BUCKET_BITS) + 1, np.float32)
    return Model(weights[:-1].copy(), float(weights[-1]))


def score(texts: list[bytes], model: Model) -> np.ndarray:
    out = np.zeros(len(texts))
    for a, b in common.blocks(texts, BLOCK_BYTES):
        dots, count = np.zeros(b - a), np.zeros(b - a, np.int64)
        for buckets, of in features(texts[a:b]):
            dots += np.bincount(of, model.weights[buckets].astype(float).sum(axis=1), b - a)
            count += np.bincount(of, minlength=b - a)
        out[a:b] = _sigmoid(10 * dots / np.maximum(1, 3 * count) + model.bias)
    return out


def predict(placed: DataFrame, model: Model, text_name: str = "text") -> DataFrame:
    """``placed`` with ``score``; null text is scored as the empty one."""
    shared = placed.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score(common.texts_of(batch.column(text_name)), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "score"])

    return common.map_batches(placed, work, common.with_columns(placed, "score double"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels come from folds 1-4 of 5.

    Null and empty texts have the score of the bias alone.  Null ids and repeated rows have their rows;
    long texts are scored some tokens at a time.  Other columns may have any names.  An empty table
    gives no rows.
    """
    model = train(docs, labels)
    return predict(common.id_and_text(docs), model).select(
        "doc_id",
        (common.fold_column(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"),
    )
