"""Helpers that the text operators share: shared folder, word tables, Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Maps bytes to words split by blanks: digits, a-z and every byte from 0x80 on stay, A-Z are
#: lower-cased, the rest become blanks.  Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) alphanumeric words of UTF-8 bytes."""
    return text.translate(WORD_TABLE).split()


def blank_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words between ``[\\x20\\x09-\\x0D]`` of UTF-8 bytes."""
    return text.lower().split()


def lower_ascii(column: Column) -> Column:
    """A-Z lower-cased, all else as it is; pure ASCII takes the faster built-in."""
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(
        F.translate(column, UPPER, LOWER)
    )


def fold(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def fold_column(doc_id: Column, modulus: int) -> Column:
    """The same as ``fold`` on a column."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def drawn(key: Column, wanted: int, total: Column | int) -> Column:
    """Whether a row is drawn by the hash of its key, about ``wanted`` of ``total`` rows, all if there are fewer.

    The share is a part of the 64-bit hashes in double precision, so it is not 0 for any total below 2^53.
    """
    share = F.lit(float(wanted)) / F.greatest(F.lit(1), F.lit(total) if isinstance(total, int) else total)
    return (share >= 1) | (F.xxhash64(key).cast("double") < share * F.lit(2.0**64) - F.lit(2.0**63))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _hadoop_path(spark: SparkSession, path: str):
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``, with its file system's scheme.

    Only a session on one machine (tests) may have none; it gets a local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quadrille-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    place, system = _hadoop_path(spark, folder)
    return system.makeQualified(place).toString().rstrip("/")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it of a path that Spark has qualified with its scheme."""
    if ":/" not in path:
        return pafs.LocalFileSystem(), path
    scheme, _, rest = path.partition(":/")
    return pafs.FileSystem.from_uri(path if rest.startswith("/") else f"{scheme}:///{rest}")


def write_file(path: str, data: bytes) -> None:
    system, place = filesystem(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    with system.open_output_stream(place) as out:
        out.write(data)


def read_file(path: str) -> bytes:
    system, place = filesystem(path)
    with system.open_input_file(place) as file:
        return file.read()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    place, system = _hadoop_path(spark, path)
    system.delete(place, True)


def _write(frame: DataFrame, path: str) -> DataFrame:
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    return _write(frame, new_path(frame.sparkSession, name))


class Workspace:
    """Intermediate tables of one call, in a folder of their own that goes when the call ends.

    What the call returns is written outside of it (``result``) and is its caller's to delete.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.folder, self.number = spark, name, new_path(spark, name), 0

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.folder)

    def written(self, frame: DataFrame, name: str) -> DataFrame:
        self.number += 1
        return _write(frame, f"{self.folder}/{self.number:03d}-{name}")

    def result(self, frame: DataFrame) -> DataFrame:
        return written(frame, f"{self.name}-result")


def _place(names: list[str], wanted: str) -> int:
    """Where a column stands: by its exact name, else by the only one that differs in case alone."""
    same = [i for i, n in enumerate(names) if n == wanted]
    alike = same or [i for i, n in enumerate(names) if n.lower() == wanted.lower()]
    if len(alike) != 1:
        raise ValueError(f"{len(alike)} columns are called {wanted}: {names}")
    return alike[0]


def by_place(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns named by place (c0, c1, ...), and those of ``wanted``.

    Whatever the columns are called, names that do not begin with c and a digit never clash with them.
    """
    names = docs.columns
    return docs.toDF(*(f"c{i}" for i in range(len(names)))), [f"c{_place(names, w)}" for w in wanted]


def as_before(frame: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` of a frame that began as ``by_place``, under their own names."""
    return frame.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that count, so that other columns never clash with ours."""
    placed, (key, text) = by_place(docs, id_col, text_col)
    return placed.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


#: Bytes of a batch that a worker handles at once.
BATCH_BYTES = 4 << 20

#: What workers keep between tasks, by owner; an owner's things go when another one's task begins.
_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """A dictionary that lives in the worker as long as it works for ``owner``."""
    return _kept.setdefault(owner, {})


def _begin(owner: str) -> None:
    """Frees what a reused worker holds for other owners."""
    others = [k for k in _kept if k != owner]
    for k in others:
        del _kept[k]
    if others:
        gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)  # hands freed memory back to the system


def small_batches(batches: Iterable[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order in batches of about ``most`` bytes, one row at least."""
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            if part.nbytes > most and part.num_rows > 1:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def map_batches(
    frame: DataFrame,
    work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | StructType,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """``work`` over the partitions of a frame, in batches of about ``batch_bytes`` at most."""
    owner = work.__module__

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(owner)
        yield from work(small_batches(batches, batch_bytes))

    return frame.mapInArrow(run, schema)


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


#: Bytes whose running sums are held at once.
HASH_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator: a bijection that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Tokens:
    """Tokens of a block of texts: 64-bit hashes, first bytes, lengths, and where each text's start."""

    hashes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    offsets: np.ndarray  # one more than texts
    data: np.ndarray


def hash_tokens(texts: list[bytes], classes: np.ndarray) -> Tokens:
    """Cuts texts where the class of a byte changes; class 0 is between tokens.

    A token's hash is a polynomial of its bytes, from differences of running sums, then mixed.
    """
    data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    kind = classes[data]
    if len(ends):
        kind[ends - 1] = 0
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1 if len(kind) else np.zeros(0, np.int64)
    edges = np.concatenate([[0], change, [len(data)]]) if len(kind) else np.zeros(1, np.int64)
    first, stop = edges[:-1], edges[1:]
    real = kind[first] > 0
    first, stop = first[real], stop[real]
    power, inverse = _powers_to(min(len(data), HASH_BYTES) + 1)
    hashes = (stop - first).astype(np.uint64)
    for start in range(0, len(data), HASH_BYTES):
        end = min(start + HASH_BYTES, len(data))
        sums = np.zeros(end - start + 1, np.uint64)
        np.cumsum((data[start:end].astype(np.uint64) + np.uint64(1)) * power[: end - start], out=sums[1:])
        # Tokens that touch these bytes; the first may have begun before them.
        i, j = np.searchsorted(stop, start, "right"), np.searchsorted(first, end, "left")
        a, b = np.maximum(first[i:j], start) - start, np.minimum(stop[i:j], end) - start
        own = (sums[b] - sums[a]) * inverse[a]
        if i < j and first[i] < start:
            own[:1] *= np.uint64(pow(int(_BASE), int(start - first[i]), 1 << 64))
        hashes[i:j] += own
    hashes = mix64(hashes)
    offsets = np.concatenate([[0], np.searchsorted(first, ends, "left")])
    return Tokens(hashes, first, stop - first, offsets, data)


def sum_by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]], 0 where a range is empty."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def with_columns(frame: DataFrame, more: str) -> StructType:
    """The schema of a frame and more columns, to carry its columns through a Python stage."""
    return StructType([*frame.schema.fields, *StructType.fromDDL(more).fields])


def word_numbers(text: bytes, number: Callable[[bytes], int | None], most: int = 1 << 20) -> np.ndarray:
    """``number`` of each alphanumeric word of a text (None as 0), some of the text at a time."""
    blanked, parts, at = text.translate(WORD_TABLE), [], 0
    while at < len(blanked):
        end = len(blanked) if len(blanked) - at <= most else blanked.find(b" ", at + most)
        end = len(blanked) if end < 0 else end
        parts.append(np.array([number(w) or 0 for w in blanked[at:end].split()], np.int32))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def blank_parts(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts of about ``most`` bytes, cut where words ``[^\\x20\\x09-\\x0D]+`` end."""
    at = 0
    while at < len(text):
        end = at + most
        if end < len(text):
            found = _BLANK.search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end]
        at = end


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from sorted batches."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if key != current and held:
                yield pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def loaded(owner: str, path: str, most: int = 4):
    """What was pickled into a file of the shared folder; a worker keeps ``most`` of them."""
    held = kept(owner)
    if path not in held:
        while len(held) >= most:
            del held[next(iter(held))]
        held[path] = pickle.loads(read_file(path))
    return held[path]
