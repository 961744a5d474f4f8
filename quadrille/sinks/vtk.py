"""Boxes of cells, the order of nodes in files, lists of steps and collections; files are written by ``meshes``."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Geometry
from ..functions.morton import MortonCodec


def lagrange_quad_order(order: int) -> list[tuple[int, int]]:
    """(i, j) of the nodes of a Lagrange quad in file order: corners, edges, then the inside."""
    n = order
    corners = [(0, 0), (n, 0), (n, n), (0, n)]
    inner = range(1, n)
    edges = [(i, 0) for i in inner] + [(n, j) for j in inner] + [(i, n) for i in inner] + [(0, j) for j in inner]
    return corners + edges + [(i, j) for j in inner for i in inner]


def with_boxes(cells: DataFrame, leaves: DataFrame, geometry: Geometry) -> DataFrame:
    """Cells with x0, y0, dx, dy, and z0, dz where leaves have a z."""
    axes = {a: m for a, m in zip("xyz", "ijk", strict=True) if a in leaves.columns}
    corner = leaves.select("patch_id", *(F.col(a).alias(f"__{a}") for a in axes))
    level = F.col("level")
    low = [geometry.cell_coord(F.col(f"__{a}"), level, F.col(m), d).alias(f"{a}0") for d, (a, m) in enumerate(axes.items())]
    size = [geometry.cell_size(level, d).alias(f"d{a}") for d, a in enumerate(axes)]
    return cells.join(corner, "patch_id").select(*cells.columns, *low, *size)


def with_own_boxes(cells: DataFrame, codec: MortonCodec, geometry: Geometry) -> DataFrame:
    """``with_boxes`` by the corners that the keys hold: no table of leaves is joined."""
    level, key = F.col("level"), F.col("patch_id")
    axes = list(zip("xyz", "ijk", codec.coords(key), strict=False))
    low = [geometry.cell_coord(corner, level, F.col(m), d).alias(f"{a}0") for d, (a, m, corner) in enumerate(axes)]
    size = [geometry.cell_size(level, d).alias(f"d{a}") for d, (a, *_) in enumerate(axes)]
    return cells.select(*cells.columns, *low, *size)


def list_steps(folder: str, pattern: str = r"(\d+)\.vtk$") -> list[tuple[int, str]]:
    """(step, file) of a folder, by the number that the pattern finds in the name."""
    found = [(int(m[1]), name) for name in os.listdir(folder) if (m := re.search(pattern, name))]
    return sorted(found)


def collection(files: Iterable[tuple[float, str]]) -> str:
    """An XML collection of files by time; files of one time are its parts."""
    count: dict[float, int] = {}
    lines = []
    for t, name in files:
        part = count[t] = count.get(t, -1) + 1
        lines.append(f'    <DataSet timestep="{t}" group="" part="{part}" file="{name}"/>')
    return "\n".join(['<?xml version="1.0"?>', '<VTKFile type="Collection" version="0.1">', "  <Collection>", *lines, "  </Collection>", "</VTKFile>"]) + "\n"


def write_collection(path: str, files: Iterable[tuple[float, str]]) -> None:
    with open(path, "w", encoding="ascii") as out:
        out.write(collection(files))
