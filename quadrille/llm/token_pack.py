"""Token-id output: fixed-width bit packing in binary files, in ascending doc_id order.

Documents are dealt by ranges of doc_id; each task encodes its range in order and writes files whose
ids take the fewest bits that hold the vocabulary.  A file is blocks of packed ids, then a footer:
offsets of the blocks, and for each document its id and where it starts.  Any block unpacks at once
in numpy, and a document is read without the blocks it does not touch.  A manifest table lists the
files of finished tasks only, so a repeated or lost task leaves no trace in the result.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common
from .segments import BATCH_BYTES, PieceCache

BLOCK_IDS = 4096
#: Bytes of text that one task writes, about, and tasks at most (they then write more, file after file):
#: bounds of ranges come from a sample, which has to be larger than their number.
RANGE_BYTES, MOST_RANGES = 24 << 20, 10_000
#: Ids of one file at most, about.
FILE_IDS = 16 << 20
#: New pieces that are encoded in one call.
JOINED = 256
_MAGIC = b"FWTOK001"


def bits_for(vocabulary_size: int) -> int:
    """Fewest bits that hold every id."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, one after the other, lowest bit first; the last byte is filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of what ``pack`` made."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little")
    return planes.reshape(count, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class TokenFileWriter:
    """Writes one file; ids are packed in blocks of ``block_ids`` across documents."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.held: list[bytes] = []
        self.n_held = self.n_ids = 0
        self.at, self.offsets = len(_MAGIC), []
        self.docs: list[tuple[int, bool, int]] = []
        out.write(_MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Ids as little-endian unsigned 32-bit integers."""
        self.docs.append((doc_id or 0, doc_id is not None, self.n_ids))
        self.held.append(ids)
        self.n_held += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.n_held >= 64 * self.block_ids:
            self._flush(self.n_held // self.block_ids * self.block_ids)

    def _flush(self, count: int) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        for i in range(0, count, self.block_ids):
            body = pack(ids[i : min(i + self.block_ids, count)], self.bits)
            self.offsets.append(self.at)
            self.out.write(body)
            self.at += len(body)
        self.held, self.n_held = [ids[count:].tobytes()], len(ids) - count

    def close(self) -> None:
        self._flush(self.n_held)
        table = np.array([(d, s) for d, _, s in self.docs], "<i8").reshape(-1, 2)
        known = np.array([k for _, k, _ in self.docs], np.uint8)
        footer = np.array(self.offsets, "<u8").tobytes() + table.tobytes() + known.tobytes()
        self.out.write(footer)
        self.out.write(
            struct.pack("<QQQII8s", self.at, len(self.docs), self.n_ids, self.bits, self.block_ids, _MAGIC)
        )


class TokenFile:
    """Reads a file: all documents in order, or any range of ids."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 40)
        at, self.n_docs, self.n_ids, self.bits, self.block_ids, magic = struct.unpack("<QQQII8s", file.read(40))
        if magic != _MAGIC:
            raise ValueError("not a token file")
        n_blocks = -(-self.n_ids // self.block_ids)
        file.seek(at)
        self.offsets = np.frombuffer(file.read(8 * n_blocks), "<u8").tolist() + [at]
        table = np.frombuffer(file.read(16 * self.n_docs), "<i8").reshape(-1, 2)
        self.doc_ids, self.starts = table[:, 0], np.append(table[:, 1], self.n_ids)
        self.known = np.frombuffer(file.read(self.n_docs), np.uint8).astype(bool)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to before ``stop`` in the file's order."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = start // self.block_ids, -(-stop // self.block_ids)
        self.file.seek(self.offsets[a])
        data = self.file.read(self.offsets[b] - self.offsets[a])
        first = a * self.block_ids
        if self.block_ids * self.bits % 8 == 0:  # blocks end at whole bytes and follow each other
            ids = unpack(data, min(b * self.block_ids, self.n_ids) - first, self.bits)
        else:
            ids = np.concatenate(
                [
                    unpack(
                        data[self.offsets[i] - self.offsets[a] : self.offsets[i + 1] - self.offsets[a]],
                        min(self.block_ids, self.n_ids - i * self.block_ids),
                        self.bits,
                    )
                    for i in range(a, b)
                ]
            )
        return ids[start - first : stop - first]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


class TextEncoder:
    """The tokenizers library over pieces of text that it would split anyway.

    Only for byte-level pre-tokenizers that split by their pattern, without a normalizer or a prefix
    blank; others, and texts that hold an added token, are encoded whole.
    """

    def __init__(self, tokenizer_json: str):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        rules = json.loads(tokenizer_json)
        cuts = rules.get("pre_tokenizer") or {}
        plain = rules.get("normalizer") is None and cuts.get("type") == "ByteLevel"
        plain = plain and cuts.get("add_prefix_space") is False and cuts.get("use_regex", True)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        #: Tokens that begin with a blank: where a piece starts in the ids of joined pieces.
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.cache = PieceCache(self._encode, self._encode_joined, cut_tails=plain)
        self.whole = added if plain else None

    def _encode(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode_joined(self, pieces: list[str]) -> list[bytes]:
        """Pieces that follow a blank, some thousands in one call."""
        out: list[bytes] = []
        for a in range(0, len(pieces), JOINED):
            own = pieces[a : a + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            cut = (4 * np.flatnonzero(self.opens[ids])).tolist()
            if len(cut) != len(own):  # a vocabulary whose pieces do not show by a blank
                out += self._encode([" " + p for p in own])
                continue
            data = ids.tobytes()
            out += [data[i:j] for i, j in zip(cut, [*cut[1:], len(data)], strict=True)]
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        return self.cache.encode_array(texts, self.whole)


def _write(shared, key: str, folder: str, bits: int, end_id: int | None, file_ids: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoders = common.kept(__name__)
        if key not in encoders:
            encoders.clear()
            encoders[key] = TextEncoder(shared.value)
        encoder, (fs, base) = encoders[key], common.filesystem(folder)
        fs.create_dir(base, recursive=True)
        end = b"" if end_id is None else struct.pack("<I", end_id)
        part, number, writer, out, path = common.partition_id(), 0, None, None, ""

        def close() -> pa.RecordBatch:
            writer.close()
            out.close()
            row = {"part": part, "number": number, "path": path, "n_docs": len(writer.docs), "n_ids": writer.n_ids}
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                if writer is None:
                    path = f"{folder}/part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.tok"
                    out = fs.open_output_stream(f"{base}/{path.rpartition('/')[2]}")
                    writer = TokenFileWriter(out, bits)
                writer.add(doc_id, ids + end)
                if writer.n_ids >= file_ids:
                    yield close()
                    writer, number = None, number + 1
        if writer is not None:
            yield close()

    return work


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str | None = None,
    end_id: int | None = 2,
    range_bytes: int = RANGE_BYTES,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Writes the files and returns their manifest: part, number, path, n_docs, n_ids, start.

    Rows of null doc_id come first; rows of one doc_id are ordered by a hash of the text, then by the
    text, so that many of them can be dealt to several tasks.  Null text counts as empty and has the
    end id alone.  Other columns may have any names.  An empty table makes no file.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        content = file.read()
    bits = bits_for(max(Tokenizer.from_str(content).get_vocab_size(), (end_id or 0) + 1))
    rows = common.id_and_text(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(1, -(-total // range_bytes)))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    dealt = rows.repartitionByRange(ranges, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    target = folder or common.new_path(spark, "tokens")
    work = _write(spark.sparkContext.broadcast(content), uuid.uuid4().hex, target, bits, end_id, file_ids)
    manifest = common.written(
        common.map_batches(dealt, work, "part long, number long, path string, n_docs long, n_ids long", BATCH_BYTES),
        "token-files",
    )
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    # One short row a file.
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def _read(with_ids: bool):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, base = common.filesystem(row["path"])
                size = fs.get_file_info(base).size
                with fs.open_input_file(base) as file:
                    tokens = TokenFile(file, size)
                    starts = tokens.starts.tolist()
                    i = 0
                    while i < tokens.n_docs:
                        # Documents of about a million ids at a time, one at least.
                        j = max(i + 1, int(np.searchsorted(tokens.starts, starts[i] + (1 << 20), "right")) - 1)
                        j = min(j, tokens.n_docs)
                        data = memoryview(tokens.ids(starts[i], starts[j]).astype("<u4").tobytes())
                        cut = [4 * (s - starts[i]) for s in starts[i : j + 1]]
                        own = [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]
                        columns = {
                            "doc_id": pa.array(tokens.doc_ids[i:j], pa.int64(), mask=~tokens.known[i:j]),
                            "start": pa.array([row["start"] + s for s in starts[i:j]], pa.int64()),
                            "n_tokens": pa.array([len(x) // 4 for x in own], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64()),
                        }
                        if with_ids:
                            columns["ids"] = pa.array([bytes(x) for x in own], pa.binary())
                        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                        i = j

    return work


def read_tokens(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start (over all files), n_tokens, ids_crc32, ids (little-endian unsigned 32-bit).

    A row per document of the files, repeated ones and null ids too; no files give no rows.  Without ``with_ids`` the files are read all the same, but ids stay in the tasks.
    """
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return common.map_batches(
        manifest.select("path", "start").repartition(tasks, "path"),
        _read(with_ids),
        "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""),
    )
