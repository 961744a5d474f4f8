"""Own operators on whole patches as arrays, for what no expression over a cell can say.

A patch is a row: its key and, for each field, an array of n values a side, row-major (``halo.patch_rows``).
Arrays reach an operator in Arrow batches, as numpy arrays of [patch, (k,) j, i]; nothing else meets in a task
than a batch, or the two children a side of one parent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.morton import MortonCodec
from .layout import PatchLayout


class PatchOperators(Protocol):
    """How values move between levels."""

    def interpolation(self, coarse: np.ndarray, corner: tuple[int, ...]) -> np.ndarray:
        """[patch, ...] of parents to the same shape of their child in a corner (0 or 1 along each dimension)."""

    def restriction(self, fine: np.ndarray) -> np.ndarray:
        """[child, ...] of one whole family, children in key order, to their parent's array."""


def quadrant(values: np.ndarray, corner: Sequence[int]) -> np.ndarray:
    """The part of each patch that a child covers."""
    half = [n // 2 for n in values.shape[1:]]
    return values[(slice(None), *(slice(c * h, (c + 1) * h) for c, h in zip(corner, half, strict=True)))]


def corners(rank: int) -> list[tuple[int, ...]]:
    """The corners of children in key order, the slowest dimension first."""
    return [tuple(c >> (rank - 1 - d) & 1 for d in range(rank)) for c in range(1 << rank)]


class LimitedLinear:
    """Straight lines through each cell, no steeper than to either neighbour in the patch (level at its border); means back."""

    def interpolation(self, coarse: np.ndarray, corner: tuple[int, ...]) -> np.ndarray:
        part = quadrant(coarse, corner)
        sides = range(1, coarse.ndim)
        out = part
        for a in sides:
            out = out.repeat(2, axis=a)
        for a in sides:
            step = np.diff(coarse, axis=a)
            edge = np.zeros_like(np.take(coarse, [0], axis=a))
            before, after = np.concatenate([edge, step], a), np.concatenate([step, edge], a)
            slope = np.where(before * after > 0, np.where(np.abs(before) < np.abs(after), before, after), 0.0)
            slope = quadrant(slope, corner)
            for b in sides:
                slope = slope.repeat(2, axis=b)
            sign = np.tile([-0.25, 0.25], coarse.shape[a] // 2).reshape([-1 if b == a else 1 for b in range(coarse.ndim)])
            out = out + sign * slope
        return out

    def restriction(self, fine: np.ndarray) -> np.ndarray:
        rank = fine.ndim - 1
        out = np.empty(fine.shape[1:])
        for child, corner in zip(fine, corners(rank), strict=True):
            blocks = child.reshape([s for n in child.shape for s in (n // 2, 2)]).mean(axis=tuple(range(1, 2 * rank, 2)))
            quadrant(out[None], corner)[0][...] = blocks
        return out


def _stack(column: pa.Array, sizes: Sequence[int], of: str) -> np.ndarray:
    """[row, ...] of arrays that all hold a patch's values; anything else is an error."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if column.null_count or len(flat) != len(column) * int(np.prod(sizes)) or len(set(np.diff(column.offsets.to_numpy()).tolist())) > 1:
        raise ValueError(f"{of} must hold {tuple(sizes)} values in every patch")
    return flat.reshape(len(column), *sizes)


def _list(values: np.ndarray) -> pa.ListArray:
    n, each = len(values), int(np.prod(values.shape[1:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * each, pa.int32()), np.ascontiguousarray(values).ravel())


def prolong_patches(patches: DataFrame, codec: MortonCodec, layout: PatchLayout, fields: Sequence[str], using: PatchOperators | None = None) -> DataFrame:
    """patch_id and the fields' arrays of the children of every patch: an Arrow table function over the table, no exchange."""
    using, sizes = using or LimitedLinear(), layout.sizes
    fields = list(fields)

    class Prolong:
        def eval(self, table: pa.RecordBatch) -> Iterator[pa.Table]:
            held = {f: _stack(table.column(f), sizes, f) for f in fields}
            for number, corner in enumerate(corners(len(sizes))):
                columns = [table.column("patch_id"), pa.array(np.full(table.num_rows, number, "i4"))]
                columns += [_list(using.interpolation(held[f], corner)) for f in fields]
                yield pa.table(columns, names=["parent", "child", *fields])

    shape = "parent bigint, child int, " + ", ".join(f"`{f}` array<double>" for f in fields)
    run = F.arrow_udtf(Prolong, returnType=shape)
    rows = run(patches.select(F.col("patch_id").cast("long").alias("patch_id"), *fields).asTable())
    return rows.select(codec.child(F.col("parent"), F.col("child")).alias("patch_id"), *fields)


def restrict_patches(patches: DataFrame, codec: MortonCodec, layout: PatchLayout, fields: Sequence[str], using: PatchOperators | None = None) -> DataFrame:
    """patch_id and the fields' arrays of the parents of whole families: an Arrow aggregate function, one exchange by parent."""
    using, sizes = using or LimitedLinear(), layout.sizes
    many = 1 << codec.rank

    def family(child: pa.Array, values: pa.Array) -> list[float]:
        order = np.argsort(child.to_numpy(zero_copy_only=False))
        if sorted(child.to_pylist()) != list(range(many)):
            raise ValueError("restriction needs each child of a family once")
        return using.restriction(_stack(values, sizes, "a field")[order]).ravel().tolist()

    run = F.arrow_udf(family, "array<double>")
    child = codec.offset_of(F.col("patch_id")).cast("int")
    rows = patches.select(codec.parent(F.col("patch_id")).alias("__p"), child.alias("__c"), *fields)
    return rows.groupBy(F.col("__p").alias("patch_id")).agg(*(run("__c", f).alias(f) for f in fields))


def flags_of_arrays(patches: DataFrame, layout: PatchLayout, field: str, criterion: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """patch_id, status from a function of [patch, ...] to a status each: an Arrow function over batches, no exchange."""
    sizes = layout.sizes

    def status(values: pa.Array) -> pa.Array:
        return pa.array(np.asarray(criterion(_stack(values, sizes, field))).astype(object), pa.string())

    return patches.select("patch_id", F.arrow_udf(status, "string")(field).alias("status"))


def largest_jump(values: np.ndarray) -> np.ndarray:
    """The largest difference of neighbouring cells of each patch."""
    out = np.zeros(len(values))
    for a in range(1, values.ndim):
        if values.shape[a] > 1:
            out = np.maximum(out, np.abs(np.diff(values, axis=a)).reshape(len(values), -1).max(1))
    return out
