"""Meshes in legacy VTK files as a Spark data source, ``vtk_mesh``: tasks write files and read them.

A row is a cell: its box ``x0, y0[, z0], dx, dy[, dz]`` and any other columns as fields.  Numbers become
cell data on quads (voxels with ``z0``); arrays of order x order nodal values become point data on
Lagrange quads, sampled in the task on order + 1 points a side.  Null numbers of double fields are NaN;
null boxes, null whole numbers and arrays of a wrong length fail the task.

A job's files carry its name and count only once it is committed: ``commit`` writes the job's list last
and takes away what failed or repeated tasks left, ``abort`` takes away all of it.  Readers follow the
lists; a folder without lists is read file by file (other programs' unstructured grids, binary).

With the option ``compression`` (``zstd`` or ``gzip``; ``none`` by default) each file is compressed as a whole and its name ends
accordingly; other programs read it once it is decompressed.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import basis
from ..sources.files import filesystem, qualified
from . import vtk

AXES = "xyz"
QUAD, VOXEL, LAGRANGE_QUAD = 9, 11, 70
#: Names and widths of numbers in the files (fixed by the format).
NUMBERS = {"double": ">f8", "float": ">f4", "int": ">i4", "vtktypeint64": ">i8"}
#: Corners of cells in file order, x first.
CORNERS = {QUAD: [(0, 0), (1, 0), (1, 1), (0, 1)], VOXEL: [(i, j, k) for k in (0, 1) for j in (0, 1) for i in (0, 1)]}
BOUNDS = [a + s for s in "01" for a in AXES]
CELLS_PER_FILE = 1 << 20
#: How names of files end by the option ``compression``; pyarrow compresses and decompresses by these.
ENDINGS = {"none": ".vtk", "zstd": ".vtk.zst", "gzip": ".vtk.gz"}
ROWS_PER_BATCH = 1 << 14


@dataclass
class Fields:
    """What the columns of a table of cells are: rank, scalar fields by their number type, nodal fields."""

    rank: int
    scalars: dict[str, str]
    nodal: list[str]

    @staticmethod
    def of(schema: StructType) -> Fields:
        rank = 3 if "z0" in schema.names else 2
        box = {p + a if p else a + "0" for a in AXES[:rank] for p in ("", "d")}
        if missing := box - set(schema.names):
            raise ValueError(f"a mesh needs the columns {sorted(missing)}")
        rest = [f for f in schema.fields if f.name not in box]
        nodal = [f.name for f in rest if isinstance(f.dataType, ArrayType)]
        whole = {"tinyint", "smallint", "int", "bigint"}
        scalars = {f.name: "vtktypeint64" if f.dataType.simpleString() in whole else "double" for f in rest if f.name not in nodal}
        if bad := [n for n in (*scalars, *nodal) if not n or any(c.isspace() for c in n)]:
            raise ValueError(f"names of fields may not hold blanks: {bad}")
        if nodal and rank == 3:
            raise ValueError("nodal fields are two-dimensional")
        return Fields(rank, scalars, nodal)


def _numbers(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    if kind == "double":
        return column.cast(pa.float64()).to_numpy()
    if column.null_count:
        raise ValueError("a whole number is null")
    return column.cast(pa.int64()).to_numpy()


def _nodal(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """[cell, node] of a column of arrays."""
    whole = column.combine_chunks()
    flat = whole.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    size = len(flat) // n
    if whole.null_count or math.isqrt(size) ** 2 != size or (np.diff(whole.offsets.to_numpy()) != size).any():
        raise ValueError("nodal values must be arrays of order x order numbers, as many in every cell")
    return flat.reshape(n, size)


def _shared(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct points in order of first use, number of each given point among them); equal means bit by bit."""
    bits = np.ascontiguousarray(points).view(np.uint64)
    mixed = np.zeros(len(bits), np.uint64)
    for axis in range(3):
        mixed = (mixed ^ bits[:, axis]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    _, first, inverse = np.unique(mixed, return_index=True, return_inverse=True)
    order = np.argsort(first)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    kept, number = points[first[order]], rank[inverse.ravel()]
    if (kept[number].view(np.uint64) != bits).any():  # two points with one mixed number
        return points, np.arange(len(points))
    return kept, number


def mesh_pieces(table: pa.Table, fields: Fields, ascii: bool = False, share: bool = False) -> tuple[Iterator[bytes], list[float]]:
    """The file of a table's cells in pieces, and their common box: lower corner, then upper.

    With ``share``, cells without nodal fields share corners (with those of their slice); nodes are each cell's own.
    Only a slice of cells is held in the wide form of the file.
    """
    n = table.num_rows
    low = np.column_stack([_numbers(table[f"{a}0"], "double") for a in AXES[: fields.rank]])
    size = np.column_stack([_numbers(table[f"d{a}"], "double") for a in AXES[: fields.rank]])
    if np.isnan(low).any() or np.isnan(size).any():
        raise ValueError("the box of a cell is null or NaN")
    nodes = {f: _nodal(table[f], n) for f in fields.nodal}
    scalars = {f: _numbers(table[f], number) for f, number in fields.scalars.items()}
    if nodes:
        widths = {v.shape[1] for v in nodes.values()}
        if len(widths) > 1:
            raise ValueError("nodal fields of different orders")
        order = math.isqrt(widths.pop())
        at = np.array(vtk.lagrange_quad_order(order))
        kind, unit = LAGRANGE_QUAD, at / order
        weights = np.array([basis.evaluation_row(order, p[::-1]) for p in unit])
    else:
        kind = VOXEL if fields.rank == 3 else QUAD
        unit = np.array(CORNERS[kind], float)
    m = len(unit)
    slices = [slice(k, min(n, k + ROWS_PER_BATCH)) for k in range(0, n, ROWS_PER_BATCH)]

    def corners(j: slice) -> np.ndarray:
        points = np.zeros((j.stop - j.start, m, 3))
        points[:, :, : fields.rank] = low[j, None] + unit * size[j, None]
        return points.reshape(-1, 3)

    shared = None if nodes or not share else [(kept, number.astype("i4")) for kept, number in (_shared(corners(j)) for j in slices)]
    count = n * m if shared is None else sum(len(kept) for kept, _ in shared)
    spans = np.zeros((2, 3))
    spans[0, : fields.rank] = np.minimum(low, low + size).min(0)
    spans[1, : fields.rank] = np.maximum(low, low + size).max(0)

    def put(values: np.ndarray, number: str) -> bytes:
        if ascii:
            rows = values.reshape(len(values), -1).tolist()
            return "".join(" ".join(map(repr, r)) + "\n" for r in rows).encode()
        return np.ascontiguousarray(values, NUMBERS[number]).tobytes()

    end = b"" if ascii else b"\n"

    def pieces() -> Iterator[bytes]:
        form = "ASCII" if ascii else "BINARY"
        yield f"# vtk DataFile Version 3.0\ncells\n{form}\nDATASET UNSTRUCTURED_GRID\nPOINTS {count} double\n".encode()
        for k, j in enumerate(slices):
            yield put(shared[k][0] if shared else corners(j), "double")
        yield end + f"CELLS {n} {n * (m + 1)}\n".encode()
        before = 0
        for k, j in enumerate(slices):
            cells = j.stop - j.start
            number = shared[k][1] if shared else np.arange(cells * m)
            yield put(np.column_stack([np.full(cells, m), before + number.reshape(cells, m)]), "int")
            before += len(shared[k][0]) if shared else cells * m
        yield end + f"CELL_TYPES {n}\n".encode()
        yield put(np.full(n, kind), "int") + end
        if scalars:
            yield f"CELL_DATA {n}\n".encode()
        for name, number in fields.scalars.items():
            yield f"SCALARS {name} {number} 1\nLOOKUP_TABLE default\n".encode()
            yield put(scalars[name], number) + end
        if nodes:
            yield f"POINT_DATA {n * m}\n".encode()
        for name, values in nodes.items():
            yield f"SCALARS {name} double 1\nLOOKUP_TABLE default\n".encode()
            for j in slices:
                yield put((values[j] @ weights.T).ravel(), "double")
            yield end

    return pieces(), spans.ravel().tolist()


@dataclass
class Written(WriterCommitMessage):
    files: list[list]


class MeshWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: StructType, overwrite: bool, options: dict):
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        self.fields, self.job = Fields.of(schema), uuid.uuid4().hex
        self.schema = _read_schema(self.fields.scalars, self.fields.nodal).json()
        self.cells = int(options.get("cells_per_file", CELLS_PER_FILE))
        self.ascii = str(options.get("ascii", "false")).lower() == "true"
        self.share = str(options.get("share_corners", "false")).lower() == "true"
        kind = str(options.get("compression", "none")).lower()
        if kind not in ENDINGS:
            raise ValueError(f"compression is one of {sorted(ENDINGS)}, not {kind}")
        self.ending = ENDINGS[kind]
        self.time = float(options.get("timestep", 0))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = filesystem(self.folder)
        system.create_dir(base, recursive=True)
        files, held, rows = [], [], 0

        def out() -> None:
            table = pa.Table.from_batches(held)
            pieces, span = mesh_pieces(table, self.fields, self.ascii, self.share)
            name = f"part-{self.job}-{uuid.uuid4().hex}{self.ending}"
            with system.open_output_stream(f"{base}/{name}") as file:
                for piece in pieces:
                    file.write(piece)
            files.append([name, table.num_rows, *span])

        for batch in iterator:
            while batch.num_rows:
                taken = batch.slice(0, self.cells - rows)
                batch = batch.slice(taken.num_rows)
                held.append(taken)
                rows += taken.num_rows
                if rows == self.cells:
                    out()
                    held, rows = [], 0
        if rows:
            out()
        return Written(files)

    def _clear(self, keep: set[str]) -> None:
        system, base = filesystem(self.folder)
        for name in _names(system, base):
            if name.startswith(f"part-{self.job}-") and name not in keep:
                system.delete_file(f"{base}/{name}")

    def commit(self, messages: list) -> None:
        system, base = filesystem(self.folder)
        system.create_dir(base, recursive=True)
        files = sorted(f for m in messages if m for f in m.files)
        before = _lists(system, base) if self.overwrite else {}
        self._clear({f[0] for f in files})
        made = {"timestep": self.time, "schema": self.schema, "ascii": self.ascii, "files": files}
        _put(system, f"{base}/_list-{self.job}.json", json.dumps(made))
        for name, old in before.items():
            system.delete_file(f"{base}/{name}")
            for file in old["files"]:
                system.delete_file(f"{base}/{file[0]}")
        every = [(one["timestep"], f[0]) for one in _lists(system, base).values() for f in one["files"]]
        _put(system, f"{base}/mesh.pvd", vtk.collection(sorted(every)))

    def abort(self, messages: list) -> None:
        self._clear(set())


def _put(system: pafs.FileSystem, path: str, text: str) -> None:
    with system.open_output_stream(path) as file:
        file.write(text.encode())


def _names(system: pafs.FileSystem, base: str) -> list[str]:
    found = system.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == pafs.FileType.File)


def _lists(system: pafs.FileSystem, base: str) -> dict[str, dict]:
    """The lists of committed jobs by name."""
    out = {}
    for name in _names(system, base):
        if name.startswith("_list-"):
            with system.open_input_file(f"{base}/{name}") as file:
                out[name] = json.loads(file.read())
    return out


def _is_mesh(name: str) -> bool:
    return name.endswith(tuple(ENDINGS.values()))


def _opened(system: pafs.FileSystem, path: str) -> pa.NativeFile:
    """A file of cells for reading at any place; a compressed one is decompressed into memory, where its blocks would be held anyway."""
    if path.endswith(ENDINGS["none"]):
        return system.open_input_file(path)
    with system.open_input_stream(path) as stream:
        return pa.BufferReader(stream.read())


@dataclass
class Block:
    """A run of numbers in a file: points, cells, cell_types, or a field of cells or points."""

    kind: str
    name: str
    number: str
    count: int
    at: int


def blocks(file: pa.NativeFile) -> list[Block]:
    """The blocks of a binary file; only their headings are read."""
    out: list[Block] = []

    def line() -> str:
        got = bytearray()
        while (c := file.read(1)) and c != b"\n":
            got += c
        return got.decode("ascii") if got or c else "\0"

    first, _, form = line(), line(), line().strip()
    if not first.startswith("# vtk") or form != "BINARY":
        raise ValueError(f"not a binary legacy file: {form}")
    data = ""
    while (text := line()) != "\0":
        words = text.split()
        match words:
            case ["POINTS", n, number]:
                block = Block("points", "", number, 3 * int(n), 0)
            case ["CELLS", _, n]:
                block = Block("cells", "", "int", int(n), 0)
            case ["CELL_TYPES", n]:
                block = Block("cell_types", "", "int", int(n), 0)
            case ["CELL_DATA" | "POINT_DATA" as data, count]:
                size = int(count)
                continue
            case ["SCALARS", name, number, *_]:
                line()
                block = Block(data.lower(), name, number, size, 0)
            case _:
                continue
        block.at = file.tell()
        out.append(block)
        file.seek(block.at + block.count * np.dtype(NUMBERS[block.number]).itemsize)
    return out


def _read_schema(scalars: dict[str, str], nodal: Sequence[str]) -> StructType:
    fixed = [StructField("file", StringType()), StructField("cell", LongType()), StructField("type", IntegerType())]
    fixed += [StructField(c, DoubleType()) for c in BOUNDS]
    numbers = [StructField(c, DoubleType() if t in ("double", "float") else LongType()) for c, t in scalars.items()]
    return StructType(fixed + numbers + [StructField(c, ArrayType(DoubleType())) for c in nodal])


class File(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class MeshReader(DataSourceReader):
    """A partition a file.  ``box`` (lower, then upper corner) keeps the cells that share a point with it, borders
    included; files whose listed box does not are not opened."""

    def __init__(self, folder: str, schema: StructType, box: str | None):
        self.folder, self.schema = folder.rstrip("/"), schema
        self.box = [float(v) for v in box.split(",")] if box else None
        if self.box and len(self.box) not in (4, 6):
            raise ValueError("a box has four or six numbers")

    def _meets(self, low: Sequence, high: Sequence):
        n = len(self.box) // 2
        hit = True
        for d in range(n):
            hit = hit & (low[d] <= self.box[n + d]) & (high[d] >= self.box[d])
        return hit

    def partitions(self) -> list[File]:
        system, base = filesystem(self.folder)
        lists = _lists(system, base)
        if any(one["ascii"] for one in lists.values()):
            raise ValueError("files of text are not read")
        if not lists:
            return [File(n) for n in _names(system, base) if _is_mesh(n)]
        files = [f for one in lists.values() for f in one["files"]]
        return [File(f[0]) for f in files if self.box is None or self._meets(f[2:5], f[5:8])]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, base = filesystem(self.folder)
        wanted = {f.name: f for f in self.schema.fields}
        arrow = pa.schema([(n, _ARROW[f.dataType.simpleString()]) for n, f in wanted.items()])
        held = {}
        with _opened(system, f"{base}/{partition.name}") as file:
            for b in blocks(file):
                if not b.name or b.name in wanted:
                    file.seek(b.at)
                    width = np.dtype(NUMBERS[b.number])
                    held[b.kind, b.name] = np.frombuffer(file.read_buffer(b.count * width.itemsize), width)
        types = held["cell_types", ""].astype("i4")
        points = held["points", ""].reshape(-1, 3).astype(float)
        starts, sizes = _starts(held["cells", ""].astype("i8"), len(types))
        for at in range(0, len(types), ROWS_PER_BATCH):
            first, many = starts[at : at + ROWS_PER_BATCH], sizes[at : at + ROWS_PER_BATCH]
            ends = np.cumsum(many)
            into = np.arange(ends[-1]) + np.repeat(first - (ends - many), many)
            corner = held["cells", ""][into].astype("i8")
            low = np.minimum.reduceat(points[corner], ends - many, axis=0)
            high = np.maximum.reduceat(points[corner], ends - many, axis=0)
            kept = np.ones(len(many), bool) if self.box is None else self._meets(low.T, high.T)
            columns = {"file": np.full(len(many), partition.name, object), "cell": np.arange(at, at + len(many)), "type": types[at : at + len(many)]}
            columns |= {c: v for c, v in zip(BOUNDS, np.hstack([low, high]).T, strict=True)}
            for name in wanted:
                if ("cell_data", name) in held:
                    columns[name] = held["cell_data", name][at : at + len(many)]
            out = []
            for field in arrow:
                if field.name in columns:
                    values = columns[field.name]
                    values = values if values.dtype == object else values.astype(values.dtype.newbyteorder("="))
                    out.append(pa.array(values).cast(field.type))
                elif ("point_data", field.name) in held:
                    values = held["point_data", field.name][corner].astype(float)
                    out.append(pa.ListArray.from_arrays(np.append(0, ends).astype("i4"), values))
                else:
                    out.append(pa.nulls(len(many), field.type))
            yield pa.RecordBatch.from_arrays(out, schema=arrow).filter(pa.array(kept))


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def _starts(cells: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each cell's points begin in the list of cells, and how many they are."""
    if n and len(cells) % n == 0 and (cells[:: len(cells) // n] == len(cells) // n - 1).all():
        each = len(cells) // n
        return np.arange(n) * each + 1, np.full(n, each - 1)
    starts, at = np.empty(n, "i8"), 0
    for k in range(n):
        starts[k] = at + 1
        at += 1 + int(cells[at])
    return starts, cells[starts - 1]


class MeshSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vtk_mesh"

    def schema(self) -> StructType:
        system, base = filesystem(self.options["path"].rstrip("/"))
        if lists := _lists(system, base):
            found = [StructType.fromJson(json.loads(one["schema"])) for one in lists.values()]
            fields = {f.name: f for one in found for f in one.fields}
            return StructType(list(fields.values()))
        files = [n for n in _names(system, base) if _is_mesh(n)]
        if not files:
            raise ValueError(f"no mesh in {self.options['path']}")
        with _opened(system, f"{base}/{files[0]}") as file:
            found = blocks(file)
        return _read_schema({b.name: b.number for b in found if b.kind == "cell_data"}, [b.name for b in found if b.kind == "point_data"])

    def reader(self, schema: StructType) -> MeshReader:
        return MeshReader(self.options["path"], schema, self.options.get("box"))

    def writer(self, schema: StructType, overwrite: bool) -> MeshWriter:
        return MeshWriter(self.options["path"], schema, overwrite, dict(self.options))


def write(cells: DataFrame, folder: str, mode: str = "append", near: Sequence[str] = (), **options) -> None:
    """Writes a table of cells into a folder that driver and tasks share; ``near`` clusters files by ranges of columns."""
    spark = cells.sparkSession
    spark.dataSource.register(MeshSource)
    if near:
        cells = cells.repartitionByRange(*near).sortWithinPartitions(*near)
    cells.write.format("vtk_mesh").mode(mode).options(**options).save(qualified(spark, folder))


def read(spark: SparkSession, folder: str, box: Sequence[float] | None = None) -> DataFrame:
    """file, cell, type, x0 to z1, and the fields of a folder's cells; of those that meet the box, if one is given."""
    spark.dataSource.register(MeshSource)
    reader = spark.read.format("vtk_mesh")
    if box is not None:
        reader = reader.option("box", ",".join(map(repr, map(float, box))))
    return reader.load(qualified(spark, folder))
