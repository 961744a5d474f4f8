"""Where patches and cells lie: column expressions and index arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


class Geometry:
    """A box of ``lengths`` (x, y[, z]) cut into patches of ``cells`` (x, y[, z]) cells each."""

    def __init__(self, lengths: Sequence[float], cells: Sequence[int], depth: int = 7):
        self.lengths, self.cells, self.depth = tuple(lengths), tuple(cells), depth

    def patch_size(self, level: Column, axis: int) -> Column:
        return F.lit(self.lengths[axis]) / F.pow(F.lit(2.0), level)

    def cell_size(self, level: Column, axis: int) -> Column:
        return self.patch_size(level, axis) / F.lit(float(self.cells[axis]))

    def patch_coord(self, coord: Column, axis: int) -> Column:
        """Lower corner of a patch along an axis."""
        return F.lit(self.lengths[axis]) * coord / F.lit(float(1 << self.depth))

    def cell_coord(self, coord: Column, level: Column, index: Column, axis: int) -> Column:
        """Lower corner of a cell along an axis."""
        return self.patch_coord(coord, axis) + index * self.cell_size(level, axis)

    def cell_center(self, coord: Column, level: Column, index: Column, axis: int) -> Column:
        return self.cell_coord(coord, level, index + 0.5, axis)

    def volume(self, level: Column) -> Column:
        out = F.lit(1.0)
        for axis in range(len(self.lengths)):
            out = out * self.cell_size(level, axis)
        return out

    def area(self, level: Column, axis: int) -> Column:
        """Of the cell face across an axis."""
        out = F.lit(1.0)
        for other in range(len(self.lengths)):
            if other != axis:
                out = out * self.cell_size(level, other)
        return out


def edge(level: Column, cells: int) -> Column:
    """Cell size on the unit square."""
    return F.pow(F.lit(2.0), -level) / F.lit(float(cells))


def reference_to_global(center: Column, ref: Column, size: Column) -> Column:
    return center + ref * size


def global_to_reference(center: Column, point: Column, size: Column) -> Column:
    return (point - center) / size


def linear_index(index: Sequence[Column], sizes: Sequence[int]) -> Column:
    """Row-major place of a multi-index, last one fastest."""
    out = F.lit(0)
    for i, n in zip(index, sizes, strict=True):
        out = out * n + i
    return out


def multi_index(linear: Column, sizes: Sequence[int]) -> list[Column]:
    """Inverse of ``linear_index``."""
    out, stride = [], 1
    for n in reversed(sizes):
        out.append((F.floor(linear / F.lit(stride)) % n).cast("int"))
        stride *= n
    return out[::-1]


def remove_halo(index: Sequence[Column], halo: int) -> list[Column]:
    return [i - halo for i in index]


def product(array: Column) -> Column:
    return F.aggregate(array, F.lit(1.0), lambda a, x: a * x)
