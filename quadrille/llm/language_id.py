"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1-, 2- and 3-grams per language come from a bounded, stratified sample of labelled
rows, summed by Spark.  Tasks turn them into matrices of log-probabilities, one for some languages
each, so that none grows with their number; a matrix is a file of the shared folder.  Texts are scored
in batches as sums of a matrix's gathered rows, one matrix after the other.
"""

from __future__ import annotations

import pickle
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Most labelled rows of one language that the counts come from (about; rows are drawn by hash).
SAMPLE_PER_LANGUAGE = 5_000
BUCKET_BITS = 15
NGRAMS = (1, 2, 3)
SMOOTHING = 0.1
UNKNOWN = "und"
#: Nats an n-gram against chance below which a text is in none of the languages.  N-grams that no language
#: has met score about -8; measured: other scripts -3.3 and less, texts mostly of numbers and keys -1.1 and more.
LEAST_EVIDENCE = -2.0

#: Languages of one matrix, about.
MATRIX_LANGUAGES = 64
#: Code points of text that are scored at once (fewer with more languages than MATRIX_LANGUAGES / 8).
BLOCK_CHARS = 1 << 19
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Matrix:
    """Log-probabilities of some languages."""

    languages: list[str]  # sorted
    prior: np.ndarray  # languages
    weights: np.ndarray  # buckets + 1, languages; the last row is 0


@dataclass
class Model:
    """Files of its matrices; none where no language was learnt."""

    paths: list[str]


def _pieces(texts: list[str], most: int) -> Iterator[tuple[int, str, int]]:
    """(number of the text, a piece, n-grams that begin in it): pieces overlap, their n-grams do not."""
    more = max(NGRAMS) - 1
    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text)), most):
            yield i, text[a : a + most + more], min(most, len(text) - a)


def _blocks(texts: list[str], most: int) -> Iterator[list[tuple[int, str, int]]]:
    held, size = [], 0
    for piece in _pieces(texts, most):
        if held and size + len(piece[1]) > most:
            yield held
            held, size = [], 0
        held.append(piece)
        size += len(piece[1])
    if held:
        yield held


def _grams(pieces: list[tuple[int, str, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket of every n-gram, the last bucket where none begins; offsets of pieces."""
    points = np.frombuffer("".join(p for _, p, _ in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(p) for _, p, _ in pieces], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    left = np.repeat(offsets[1:], lengths) - np.arange(len(points))
    left[lengths.repeat(lengths) - left >= np.repeat([k for _, _, k in pieces], lengths)] = 0
    h = np.zeros(len(points), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        head = points[n - 1 :]
        h = (h[: len(head)] ^ head) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in NGRAMS:
            bucket = np.full(len(points), 1 << BUCKET_BITS, np.int32)
            mixed = (h * np.uint32(0x85EBCA6B + 2 * n)) >> np.uint32(32 - BUCKET_BITS)
            bucket[: len(head)] = np.where(left[: len(head)] >= n, mixed, 1 << BUCKET_BITS)
            yield bucket, offsets


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of buckets per language, handed on when a task has met many languages."""
    size = (1 << BUCKET_BITS) + 1
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(size, np.int64))

    def out() -> Iterator[pa.RecordBatch]:
        for lang, vector in counts.items():
            some = np.flatnonzero(vector[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(vector[some])],
                names=["lang", "bucket", "n"],
            )
        counts.clear()

    for batch in batches:
        by: dict[str, list[str]] = defaultdict(list)
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by[lang].append((text or "").lower())
        for lang, own in by.items():
            for pieces in _blocks(own, BLOCK_CHARS):
                for bucket, _ in _grams(pieces):
                    counts[lang] += np.bincount(bucket, minlength=size)
            if len(counts) > MATRIX_LANGUAGES:
                yield from out()
    yield from out()


def _build(folder: str, documents: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part and language; each part becomes a matrix."""
        for group in common.grouped(batches, ["part"]):
            languages, of = np.unique(group["lang"].to_pylist(), return_inverse=True)
            counts = np.full((1 << BUCKET_BITS, len(languages)), SMOOTHING)
            known = group["bucket"].is_valid().to_numpy()
            np.add.at(counts, (group["bucket"].filter(known).to_numpy(), of[known]), group["n"].filter(known).to_numpy())
            docs = np.ones(len(languages))
            docs[of] = group["docs"].to_numpy()
            logs = np.log(counts * (1 << BUCKET_BITS) / counts.sum(axis=0))
            path = f"{folder}/{group['part'][0].as_py():06d}-{uuid.uuid4().hex}"
            matrix = Matrix(languages.tolist(), np.log(docs / documents), np.vstack([logs, np.zeros(len(languages))]))
            common.write_file(path, pickle.dumps(matrix))
            yield pa.RecordBatch.from_pylist([{"path": path}])

    return work


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, matrix_languages: int = MATRIX_LANGUAGES) -> Model:
    """Fits on columns doc_id, text, lang; rows of null lang or text are left out, repeated ones count.

    Of each language about ``per_language`` rows at most are used, drawn by a hash of doc_id.  The files
    of the model stay in the shared folder.
    """
    spark = labelled.sparkSession
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = common.written(usable.groupBy("lang").agg(F.count("*").alias("docs")), "languages")
    row = totals.agg(F.count("*").alias("languages"), F.sum("docs").alias("docs")).first()
    if not row.languages:
        return Model([])
    drawn = usable.join(totals, "lang").filter(common.drawn(F.col("doc_id"), per_language, F.col("docs")))
    counted = (
        common.map_batches(drawn.select("lang", "text"), _count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    parts = -(-row.languages // matrix_languages)
    part = F.pmod(F.xxhash64("lang"), F.lit(parts)).cast("long").alias("part")
    rows = totals.join(counted, "lang", "left").select(part, "lang", "docs", "bucket", "n")
    dealt = rows.repartition(parts, "part").sortWithinPartitions("part", "lang")
    files = common.map_batches(dealt, _build(common.new_path(spark, "language-matrices"), row.docs), "path string")
    return Model(sorted(r.path for r in files.collect()))  # one a matrix


def score(texts: list[str | None], matrices: Iterable[Matrix]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Best language (the first in order of equal ones), its posterior probability, and the evidence of each text.

    The evidence is the largest log-likelihood ratio of a language against n-grams that fall into all
    buckets alike, an n-gram of the text and without priors: above 0 where a language explains it better than chance.
    """
    lowered = [(t or "").lower() for t in texts]
    best: list[str | None] = [None] * len(texts)
    top, mass = np.full(len(texts), -np.inf), np.zeros(len(texts))  # largest total; sum of exp(total - top)
    evidence = np.full(len(texts), -np.inf)
    for matrix in matrices:
        total = np.tile(matrix.prior, (len(texts), 1))
        most = max(4096, BLOCK_CHARS * 8 // max(8, len(matrix.languages)))
        for pieces in _blocks(lowered, most):
            at = [i for i, _, _ in pieces]
            for bucket, offsets in _grams(pieces):
                np.add.at(total, at, common.sum_by_text(matrix.weights[bucket], offsets))
        first, largest = total.argmax(axis=1), total.max(axis=1)
        evidence = np.maximum(evidence, (total - matrix.prior).max(axis=1))
        for i in range(len(texts)):
            name = matrix.languages[first[i]]
            if best[i] is None or largest[i] > top[i] or (largest[i] == top[i] and name < best[i]):
                best[i] = name
        higher = np.maximum(top, largest)
        mass = mass * np.exp(top - higher) + np.exp(total - higher[:, None]).sum(axis=1)
        top = higher
    told = [b is not None and bool(_LETTER.search(t)) for b, t in zip(best, lowered, strict=True)]
    sure = np.where(told, 1 / np.where(mass > 0, mass, 1), 0.0)
    grams = np.array([sum(max(0, len(t) - n + 1) for n in NGRAMS) for t in lowered], float)
    return [b if k else UNKNOWN for b, k in zip(best, told, strict=True)], sure, np.where(told, evidence / np.maximum(grams, 1), -np.inf)


def predict(placed: DataFrame, model: Model, text_name: str = "text") -> DataFrame:
    """``placed`` with ``lang_pred``, ``score`` and ``evidence``.

    ``und`` with score 0 and evidence of minus infinity for null texts, texts without a letter, or a model that saw no language.
    """
    paths = model.paths

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_name).to_pylist()
            best, sure, evidence = score(texts, (common.loaded(__name__, path) for path in paths))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best, pa.string()), pa.array(sure), pa.array(evidence)],
                names=[*batch.schema.names, "lang_pred", "score", "evidence"],
            )

    return common.map_batches(placed, work, common.with_columns(placed, "lang_pred string, score double, evidence double"))


def training_rows(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, text, lang of the rows that are not held out (default: fold 0 of 5)."""
    placed, (key, text, lang) = common.by_place(docs, "doc_id", "text", "lang")
    rows = placed.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    )
    return rows.filter(~(common.fold_column(F.col("doc_id"), 5) == 0 if held_out is None else held_out))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learnt from folds 1-4 of 5.

    Null texts and texts without a letter are ``und`` with score 0, as all are when there is nothing to
    learn from.  Null ids and repeated rows have their rows; long texts are scored in pieces.  Other
    columns may have any names.  An empty table gives no rows.
    """
    model = train(training_rows(docs))
    held_out = (common.fold_column(F.col("doc_id"), 5) == 0).alias("held_out")
    return predict(common.id_and_text(docs), model).select("doc_id", held_out, "lang_pred", "score")


def _with_letter(text_name: str):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_name).to_pylist()
            yield batch.filter(pa.array([bool(_LETTER.search((t or "").lower())) for t in texts], pa.bool_()))

    return work


def keep_identified(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are in none of the learnt languages; same columns.

    Rows go that have no letter (``und``, null texts too), and those whose n-grams every language explains
    far worse than chance does (evidence under ``LEAST_EVIDENCE``: letters of other scripts, mostly).  Which
    of the languages a text is in, and how sure that is among them, rejects nothing.  With no labels to learn
    from, the letter decides alone.  Other columns may have any names.  Repeated rows are decided alike.
    An empty table gives an empty one.
    """
    placed, (text,) = common.by_place(docs, text_col)
    placed = placed.withColumn(text, F.col(text).cast("string"))
    model = train(training_rows(docs))
    if not model.paths:
        return common.as_before(common.map_batches(placed, _with_letter(text), placed.schema), docs)
    found = predict(placed, model, text)
    return common.as_before(found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("evidence") >= LEAST_EVIDENCE)), docs)
