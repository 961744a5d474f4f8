"""Exact dedup with an extendible-hash index on shared files.

Texts are equal when identical after lower-casing A-Z.  Each input task first folds its own equal
texts, some at a time, into one candidate, so a text that fills a third of the table sends a row per
fold onward, not one per document.  The key space (the first 64 bits of the text's SHA-256) is cut
into ranges; one owner task at a time holds a range, fills an extendible-hash index with its
candidates (a bucket that overflows is split by its next bit, and the directory doubles when that
bucket already uses every directory bit), chains entries of one key and tells them apart by their
bytes.  It writes the index of its range to the shared folder, and looks all candidates up in the
file: what the file says is their verdict, and reaches the documents through the fold they were in.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of text that one key range should hold, and tasks at most that own ranges (several each, then).
RANGE_BYTES, MOST_TASKS = 16 << 20, 20_000
#: Entries of a bucket before it is split.
BUCKET_ENTRIES = 64
#: Bytes of text and rows that an input task folds before it hands its candidates on.
FOLD_BYTES, FOLD_ROWS = 16 << 20, 100_000


@dataclass
class Entry:
    key: int
    text: bytes
    best: tuple
    count: int


@dataclass
class Bucket:
    depth: int
    entries: list[Entry] = field(default_factory=list)


class ExtendibleIndex:
    """Directory of 2**depth slots over buckets; low bits of a key choose the slot."""

    def __init__(self, capacity: int = BUCKET_ENTRIES, key_bits: int = 64):
        self.capacity, self.key_bits, self.depth = capacity, key_bits, 0
        self.directory = [Bucket(0)]

    def _bucket(self, key: int) -> Bucket:
        return self.directory[key & ((1 << self.depth) - 1)]

    def find(self, key: int, text: bytes) -> Entry | None:
        """Walks the chain of a key and compares bytes."""
        return next((e for e in self._bucket(key).entries if e.key == key and e.text == text), None)

    def add(self, entry: Entry) -> None:
        """Adds to the equal text's entry, or as a new entry."""
        if found := self.find(entry.key, entry.text):
            found.count += entry.count
            found.best = max(found.best, entry.best)
            return
        bucket = self._bucket(entry.key)
        bucket.entries.append(entry)
        while len(bucket.entries) > self.capacity and self._can_split(bucket):
            bucket = self._split(bucket, entry.key)

    def _can_split(self, bucket: Bucket) -> bool:
        """Entries that all share one key stay chained in their bucket, however many."""
        first = bucket.entries[0].key
        return bucket.depth < self.key_bits and any(e.key != first for e in bucket.entries)

    def _split(self, bucket: Bucket, key: int) -> Bucket:
        if bucket.depth == self.depth:
            self.directory += self.directory
            self.depth += 1
        bit = 1 << bucket.depth
        pair = Bucket(bucket.depth + 1), Bucket(bucket.depth + 1)
        for e in bucket.entries:
            pair[bool(e.key & bit)].entries.append(e)
        for slot in range(key & (bit - 1), len(self.directory), bit):
            self.directory[slot] = pair[bool(slot & bit)]
        return self._bucket(key)

    def buckets(self) -> list[Bucket]:
        return list({id(b): b for b in self.directory}.values())

    def entries(self) -> Iterator[Entry]:
        for bucket in self.buckets():
            yield from bucket.entries


_ENTRY = struct.Struct("<Q?qqQQ")


def save_range(index: ExtendibleIndex, folder: str, number: int) -> str:
    """One file a range: header, directory (slot to bucket), bucket offsets, compressed buckets.

    Every attempt of a task writes a file of its own name; only what a finished one returns is read.
    """
    buckets = index.buckets()
    place = {id(b): i for i, b in enumerate(buckets)}
    pack = zstandard.ZstdCompressor(level=1)
    bodies = []
    for b in buckets:
        raw = b"".join(
            _ENTRY.pack(e.key, e.best[0], e.best[1], e.best[2], e.count, len(e.text)) + e.text for e in b.entries
        )
        bodies.append(struct.pack("<II", b.depth, len(b.entries)) + pack.compress(raw))
    slots = struct.pack(f"<{len(index.directory)}I", *(place[id(b)] for b in index.directory))
    ends, at = [], 0
    for body in bodies:
        at += len(body)
        ends.append(at)
    head = struct.pack("<4sIII", b"XDI2", index.depth, len(index.directory), len(bodies))
    path = f"{folder}/range-{number:07d}-{uuid.uuid4().hex}.idx"
    common.write_file(path, b"".join([head, slots, struct.pack(f"<{len(ends)}Q", *ends), *bodies]))
    return path


class RangeFile:
    """Finds texts in what ``save_range`` wrote: directory, then one bucket, unpacked when first asked."""

    def __init__(self, path: str):
        self.data = common.read_file(path)
        magic, self.depth, n_slots, n_buckets = struct.unpack_from("<4sIII", self.data)
        if magic != b"XDI2":
            raise ValueError("not an index file")
        self.slots = struct.unpack_from(f"<{n_slots}I", self.data, 16)
        at = 16 + 4 * n_slots
        self.ends = (0, *struct.unpack_from(f"<{n_buckets}Q", self.data, at))
        self.start = at + 8 * n_buckets
        self.open: dict[int, Bucket] = {}

    def bucket(self, number: int) -> Bucket:
        if number not in self.open:
            a, b = self.start + self.ends[number], self.start + self.ends[number + 1]
            depth, count = struct.unpack_from("<II", self.data, a)
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(self.data[a + 8 : b])
            bucket, p = Bucket(depth), 0
            for _ in range(count):
                key, known, doc_id, fold, n, size = _ENTRY.unpack_from(raw, p)
                p += _ENTRY.size
                bucket.entries.append(Entry(key, raw[p : p + size], (known, doc_id, fold), n))
                p += size
            self.open[number] = bucket
        return self.open[number]

    def find(self, key: int, text: bytes) -> Entry | None:
        """Walks the chain of a key and compares bytes."""
        entries = self.bucket(self.slots[key & ((1 << self.depth) - 1)]).entries
        return next((e for e in entries if e.key == key and e.text == text), None)


def _keyed(text: bytes, key_bits: int) -> tuple[int, bytes]:
    digest = hashlib.sha256(text).digest()
    return int.from_bytes(digest[:8], "big") >> (64 - key_bits), digest


def _fold(key_bits: int, n_ranges: int, text_name: str, id_name: str):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of equal texts in a fold the row of the largest doc_id, with all their ids; bytes are compared."""
        held: list[pa.RecordBatch] = []
        best: dict[bytes, list] = {}
        size = rows = 0
        fold = common.partition_id() << 36

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal fold
            by: list[list[tuple]] = [[] for _ in held]
            for text, (which, i, _, ids) in best.items():
                by[which].append((i, _keyed(text, key_bits), ids))
            for batch, own in zip(held, by, strict=True):
                if not own:
                    continue
                own.sort(key=lambda x: x[0])
                keys = [k for _, k, _ in own]
                extra = {
                    "fold": pa.array(range(fold, fold + len(own)), pa.int64()),
                    "key": pa.array([k - (1 << 63) for k in keys], pa.int64()),
                    "span": pa.array([(k * n_ranges) >> key_bits for k in keys], pa.int64()),
                    "ids": pa.array([ids for _, _, ids in own], pa.list_(pa.int64())),
                }
                fold += len(own)
                rows = batch.take(pa.array([i for i, _, _ in own], pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, *extra.values()], names=[*rows.schema.names, *extra])

        for batch in batches:
            ids = batch.column(id_name).cast(pa.int64()).to_pylist()
            for i, text in enumerate(common.texts_of(batch.column(text_name))):
                text = text.lower()
                rank = _rank(ids[i])
                seen = best.get(text)
                if seen is None:
                    best[text] = [len(held), i, rank, [ids[i]]]
                    size += len(text)
                else:
                    seen[3].append(ids[i])
                    if rank > seen[2]:
                        seen[0], seen[1], seen[2] = len(held), i, rank
            held.append(batch)
            rows += batch.num_rows
            if size > FOLD_BYTES or rows > FOLD_ROWS:
                yield from out()
                held, best, size, rows = [], {}, 0, 0
        yield from out()

    return work


def _keyed(text: bytes, key_bits: int) -> int:
    return int.from_bytes(hashlib.sha256(text).digest()[:8], "big") >> (64 - key_bits)


def _rank(doc_id: int | None) -> tuple[bool, int]:
    """Order of rows in a group: the largest doc_id stays, a null one only among nulls."""
    return doc_id is not None, doc_id or 0


def _own(key_bits: int, folder: str, capacity: int, names: list[str], text_name: str, id_name: str):
    """Owners of ranges; with ``names`` they give out the rows that stay, else a verdict a candidate."""

    def verdicts(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        index = ExtendibleIndex(capacity, key_bits)
        columns = [[b.column(c).to_pylist() for c in ("key", "fold", "n")] for b in held]
        ids = [b.column(id_name).cast(pa.int64()).to_pylist() for b in held]
        for (keys, folds, counts), own, batch in zip(columns, ids, held, strict=True):
            for i, text in enumerate(common.texts_of(batch.column(text_name))):
                index.add(Entry(keys[i] + (1 << 63), text.lower(), (*_rank(own[i]), folds[i]), counts[i]))
        path = save_range(index, folder, number)
        del index
        file = RangeFile(path)
        for (keys, folds, _), batch in zip(columns, held, strict=True):
            found, shas = [], []
            for i, text in enumerate(common.texts_of(batch.column(text_name))):
                text = text.lower()
                found.append(file.find(keys[i] + (1 << 63), text))
                shas.append("" if names else hashlib.sha256(text).hexdigest())
            if names:
                stays = pa.array([e.best[2] == f for e, f in zip(found, folds, strict=True)], pa.bool_())
                yield batch.select(names).filter(stays)
            else:
                keep = [e.best[1] if e.best[0] else None for e in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("fold"), pa.array(keep, pa.int64()), pa.array([e.count for e in found], pa.int64()), pa.array(shas), pa.array([path] * len(found))],
                    names=["fold", "keep_id", "group_size", "text_sha256", "index_file"],
                )

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by range; each range is indexed, saved and looked up in turn."""
        for group in common.grouped(batches, ["span"]):
            yield from verdicts(group.to_batches(), group["span"][0].as_py())

    return work


def _folded(placed: DataFrame, text: str, key: str, key_bits: int, range_bytes: int) -> tuple[DataFrame, int]:
    """Candidates of ``placed``: its columns, fold, key, span (the range), ids; and how many tasks own them."""
    spark = placed.sparkSession
    total = placed.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_ranges = max(1, -(-total // range_bytes))
    schema = common.with_columns(placed, "fold long, key long, span long, ids array<long>")
    tasks = min(MOST_TASKS, max(n_ranges, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return common.map_batches(placed, _fold(key_bits, n_ranges, text, key), schema), tasks


def _owned(folded: DataFrame, tasks: int, work, schema) -> DataFrame:
    slim = folded.withColumn("n", F.size("ids").cast("long")).drop("ids")
    return common.map_batches(slim.repartition(tasks, "span").sortWithinPartitions("span", "key"), work, schema)


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    key_bits: int = 64,
    range_bytes: int = RANGE_BYTES,
    bucket_entries: int = BUCKET_ENTRIES,
    index_dir: str | None = None,
) -> DataFrame:
    """One row, with all its columns, of every distinct normalised text: that of the largest doc_id.

    Null text counts as empty.  Of rows with equal doc_id and text one stays.  A null doc_id stays
    only if no other row has the text.  Other columns may have any names.  A text is held in memory,
    and a range of them.  An empty table gives an empty one.  ``index_dir`` says where the index files
    go (default: a new folder below the shared one).
    """
    placed, (key, text) = common.by_place(docs, id_col, text_col)
    folder = index_dir or common.new_path(docs.sparkSession, "exact-index")
    folded, tasks = _folded(placed.withColumn(text, F.col(text).cast("string")), text, key, key_bits, range_bytes)
    names = placed.columns
    kept = _owned(folded, tasks, _own(key_bits, folder, bucket_entries, names, text, key), folded.select(*names).schema)
    return common.as_before(kept, docs)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    key_bits: int = 64,
    range_bytes: int = RANGE_BYTES,
    bucket_entries: int = BUCKET_ENTRIES,
    index_dir: str | None = None,
) -> DataFrame:
    """A verdict for every row: doc_id, keep_id, group_size, kept, text_sha256, index_file.

    Null text counts as empty.  Rows that repeat both doc_id and text cannot be told apart by id
    and share one verdict (``deduplicate`` keeps one of them); a null doc_id is kept only if its
    text occurs with no other id.  An empty table gives no rows.  The index files stay if
    ``index_dir`` says where they go.
    """
    slim = common.id_and_text(docs, id_col, text_col)
    with common.Workspace(docs.sparkSession, "exact-dedup") as ws:
        folded, tasks = _folded(slim, "text", "doc_id", key_bits, range_bytes)
        folded = ws.written(folded, "candidates")
        work = _own(key_bits, index_dir or f"{ws.folder}/index", bucket_entries, [], "text", "doc_id")
        schema = "fold long, keep_id long, group_size long, text_sha256 string, index_file string"
        verdicts = _owned(folded, tasks, work, schema)
        rows = folded.select("fold", "ids").join(verdicts, "fold").withColumn("doc_id", F.explode("ids"))
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
        return ws.result(rows.select("doc_id", "keep_id", "group_size", kept, "text_sha256", "index_file"))
