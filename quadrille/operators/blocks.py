"""Patch-grain stepping of uniform periodic grids: several steps for one exchange of halos.

A row is a patch: its place and one block of doubles per field.  Each round sends every patch, with
a margin as wide as the round has steps, to itself and its eight neighbours in one shuffle; a task
then assembles the padded patch in numpy and takes all steps of the round on it.  Cells that the
margin no longer covers are cut, so the result is that of single steps.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Kernel(Protocol):
    """fields, and the flux between two states along an axis (0 is x), over arrays (field, ...)."""

    fields: tuple[str, ...]

    def flux(self, left: np.ndarray, right: np.ndarray, axis: int) -> np.ndarray: ...


class AdvectionKernel:
    fields = ("u",)

    def __init__(self, velocity=(1.0, 0.5)):
        self.velocity = velocity

    def flux(self, left, right, axis):
        v = self.velocity[axis]
        return (left if v >= 0 else right) * v


class EulerKernel:
    fields = ("rho", "mx", "my", "e")

    def __init__(self, gamma=1.4):
        self.gamma = gamma

    def _parts(self, s, axis):
        inverse = 1 / s[0]
        along = s[1 + axis] * inverse
        p = (self.gamma - 1) * (s[3] - 0.5 * (s[1] * s[1] + s[2] * s[2]) * inverse)
        f = s * along
        f[1 + axis] += p
        f[3] += p * along
        return f, np.abs(along) + np.sqrt(self.gamma * p * inverse)

    def flux(self, left, right, axis):
        (fl, al), (fr, ar) = self._parts(left, axis), self._parts(right, axis)
        return 0.5 * (fl + fr - np.maximum(al, ar) * (right - left))


def advance_block(block: np.ndarray, kernel: Kernel, ratio: tuple[float, float], steps: int) -> np.ndarray:
    """Steps a padded block (field, y, x); each step uses up one cell of margin on every side."""
    for _ in range(steps):
        fx = kernel.flux(block[:, 1:-1, :-1], block[:, 1:-1, 1:], 0)
        fy = kernel.flux(block[:, :-1, 1:-1], block[:, 1:, 1:-1], 1)
        block = block[:, 1:-1, 1:-1] - ratio[0] * (fx[:, :, 1:] - fx[:, :, :-1]) - ratio[1] * (fy[:, 1:] - fy[:, :-1])
    return block


def to_blocks(cells: DataFrame, fields: tuple[str, ...], n: int) -> DataFrame:
    """px, py, data: patches of n by n cells from rows x, y, fields; data is float64, (field, y, x)."""
    place = (F.col("y") % n) * n + F.col("x") % n
    packed = cells.groupBy(F.floor(F.col("x") / n).alias("px"), F.floor(F.col("y") / n).alias("py")).agg(
        F.array_sort(F.collect_list(F.struct(place.alias("k"), F.array(*fields).alias("v")))).alias("rows")
    )

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column("v").flatten().flatten().to_numpy().reshape(b.num_rows, n, n, len(fields))
            data = [np.ascontiguousarray(v.transpose(2, 0, 1)).tobytes() for v in values]
            yield pa.RecordBatch.from_arrays([b.column("px"), b.column("py"), pa.array(data, pa.binary())], names=["px", "py", "data"])

    return packed.select("px", "py", F.col("rows.v").alias("v")).mapInArrow(work, "px long, py long, data binary")


def to_cells(blocks: DataFrame, fields: tuple[str, ...], n: int) -> DataFrame:
    """Rows x, y, fields of patches."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j, i = (a.ravel() for a in np.mgrid[0:n, 0:n])
        for b in batches:
            for px, py, data in zip(*(b.column(c).to_pylist() for c in ("px", "py", "data")), strict=True):
                block = np.frombuffer(data, np.float64).reshape(len(fields), n * n)
                yield pa.RecordBatch.from_arrays([pa.array(px * n + i), pa.array(py * n + j), *map(pa.array, block)], names=["x", "y", *fields])

    return blocks.mapInArrow(work, "x long, y long, " + ", ".join(f"{f} double" for f in fields))


def round_of_steps(blocks: DataFrame, kernel: Kernel, n: int, patches: int, dt: float, spacing: tuple[float, float], steps: int) -> DataFrame:
    """``steps`` steps of all patches (``patches`` along each side of a grid) with one shuffle.

    Grids stand one above the other along y, each periodic in itself.
    """
    if not 1 <= steps <= n:
        raise ValueError("a round has 1 to n steps")
    nf, s = len(kernel.fields), steps
    ratio = (dt / spacing[0], dt / spacing[1])
    cut = {-1: slice(n - s, n), 0: slice(0, n), 1: slice(0, s)}  # what a neighbour at an offset sends
    put = {-1: slice(0, s), 0: slice(s, n + s), 1: slice(n + s, n + 2 * s)}

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for px, py, data in zip(*(b.column(c).to_pylist() for c in ("px", "py", "data")), strict=True):
                block = np.frombuffer(data, np.float64).reshape(nf, n, n)
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        row = ((px - dx) % patches, py - py % patches + (py - dy) % patches, dx, dy, np.ascontiguousarray(block[:, cut[dy], cut[dx]]).tobytes())
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["px", "py", "dx", "dy", "data"])

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by patch, nine a patch."""
        held, count, block = None, 0, np.empty((nf, n + 2 * s, n + 2 * s))
        for b in batches:
            keys, data = [], []
            for px, py, dx, dy, part in zip(*(b.column(c).to_pylist() for c in ("px", "py", "dx", "dy", "data")), strict=True):
                if (px, py) != held:
                    held, count, block = (px, py), 0, np.empty((nf, n + 2 * s, n + 2 * s))
                target = block[:, put[dy], put[dx]]
                target[...] = np.frombuffer(part, np.float64).reshape(target.shape)
                count += 1
                if count == 9:
                    keys.append(held)
                    data.append(advance_block(block, kernel, ratio, s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(data, pa.binary())],
                names=["px", "py", "data"],
            )

    sent = blocks.mapInArrow(send, "px long, py long, dx int, dy int, data binary")
    return sent.repartition("px", "py").sortWithinPartitions("px", "py").mapInArrow(assemble, "px long, py long, data binary")


def run_blocks(
    cells: DataFrame,
    kernel: Kernel,
    extent: int,
    dt: float,
    steps: int,
    n: int = 32,
    spacing: tuple[float, float] | None = None,
    per_round: int = 8,
    rounds_per_cut: int = 4,
    by: str | None = None,
) -> DataFrame:
    """``steps`` steps of a periodic grid of ``extent`` cells a side; back as rows x, y, fields.

    ``by``, where given, is the number of a row's grid, from 0.
    """
    spacing = spacing or (1 / extent, 1 / extent)
    if by:
        cells = cells.withColumn("y", F.col(by) * extent + F.col("y"))
    blocks, done, rounds = to_blocks(cells, kernel.fields, n), 0, 0
    while done < steps:
        k = min(per_round, n, steps - done)
        blocks = round_of_steps(blocks, kernel, n, extent // n, dt, spacing, k)
        done, rounds = done + k, rounds + 1
        if rounds % rounds_per_cut == 0 and done < steps:
            blocks = blocks.checkpoint()
    out = to_cells(blocks, kernel.fields, n)
    if not by:
        return out
    return out.select(F.floor(F.col("y") / extent).alias(by), "x", (F.col("y") % extent).alias("y"), *kernel.fields)
