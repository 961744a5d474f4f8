"""Explicit finite-volume steps: flux differences over cells, on uniform and on refined grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Geometry
from ..functions.morton import MortonCodec
from ..functions.physics import Equation
from .halo import patch_rows, with_faces
from .layout import PatchLayout

#: Waves slower than this do not limit the time step.
SLOWEST = 1e-12


def _state(prefix: str, fields: Sequence[str]) -> dict[str, Column]:
    return {f: F.col(f"{prefix}{f}") for f in fields}


def cfl_limit(cells: DataFrame, equation: Equation, spacing: Sequence[Column], cfl: float, by: Sequence[str] = ()) -> DataFrame:
    """``dt``: cfl times the least spacing over wave speed of all cells and axes; one row, or one for each ``by``."""
    return cells.groupBy(*by).agg(cfl_measure(equation, spacing, cfl).alias("dt"))


def cfl_measure(equation: Equation, spacing: Sequence[Column], cfl: float) -> Column:
    """The aggregate of ``cfl_limit``, also for the pass that writes a state."""
    state = _state("", equation.fields)
    steps = [F.when(equation.speed(state, a) > SLOWEST, h / equation.speed(state, a)) for a, h in enumerate(spacing)]
    least = F.least(*steps) if len(steps) > 1 else steps[0]
    return F.min(least) * cfl


#: Cells of a block along an axis at most, in a step on a uniform grid.
BLOCK = 32


def uniform_step(
    cells: DataFrame, equation: Equation, dt: float | Column, spacing: Sequence[float], extent: int, by: Sequence[str] = ()
) -> DataFrame:
    """One step on a periodic grid of ``extent`` cells a side: x[, y[, z]] and the fields.

    Columns ``by`` tell the grids of a table of many apart.

    The grid is cut into blocks; cells at a block's edge also go to the block beside it, so one shuffle
    by block brings all neighbours together, and windows run along the lines of a block only.
    """
    axes = ["x", "y", "z"][: len(spacing)]
    fields = list(equation.fields)
    dt = F.lit(dt) if isinstance(dt, float) else dt
    size = max(b for b in range(1, min(BLOCK, extent) + 1) if extent % b == 0)
    blocks = [f"__b{a}" for a in axes]
    home = [F.floor(F.col(a) / size).cast("long") for a in axes]
    local = [(F.col(a) % size).cast("long") for a in axes]

    def copy(axis: int | None, step: int) -> Column:
        """The cell in its own block, or just outside of the block beside it."""
        to = [F.pmod(h + step, F.lit(extent // size)) if i == axis else h for i, h in enumerate(home)]
        at = [v - step * size if i == axis else v for i, v in enumerate(local)]
        named = [t.alias(n) for t, n in zip(to, blocks, strict=True)] + [v.alias(n) for v, n in zip(at, axes, strict=True)]
        row = F.struct(*named, F.lit(axis is None).alias("__inside"))
        if axis is None:
            return row
        return F.when(local[axis] == (0 if step < 0 else size - 1), row)

    copies = F.array(copy(None, 0), *(copy(i, step) for i in range(len(axes)) for step in (-1, 1)))
    own = F.struct(*fields)
    work = (
        cells.select(*by, F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("c"), own.alias("__own"))
        .select(*by, "c.*", "__own")
        .repartition(*by, *blocks)
    )
    for axis in axes:
        line = Window.partitionBy(*by, *blocks, *(a for a in axes if a != axis)).orderBy(axis)
        work = work.withColumns({f"__l{axis}": F.lag("__own").over(line), f"__r{axis}": F.lead("__own").over(line)})
    work = work.filter("__inside")
    here = _state("__own.", fields)
    change = {f: F.lit(0.0) for f in fields}
    for a, axis in enumerate(axes):
        into = equation.flux(_state(f"__l{axis}.", fields), here, a)
        out = equation.flux(here, _state(f"__r{axis}.", fields), a)
        for f in fields:
            change[f] = change[f] + (out[f] - into[f]) * (dt / F.lit(spacing[a]))
    place = [(F.col(b) * size + F.col(a)).alias(a) for a, b in zip(axes, blocks, strict=True)]
    return work.select(*by, *place, *((here[f] - change[f]).alias(f) for f in fields))


def refined_step(
    cells: DataFrame,
    leaves: DataFrame,
    equation: Equation,
    dt: float | Column,
    geometry: Geometry,
    codec: MortonCodec,
    layout: PatchLayout,
    nbr: DataFrame | None = None,
) -> DataFrame:
    """One step on a leaf set, of cells of whole patches: packed into arrays, then as ``refined_patch_step``."""
    patches = patch_rows(cells, layout, list(equation.fields))
    return refined_patch_step(patches, leaves, equation, dt, geometry, codec, layout, nbr)


def refined_patch_step(
    patches: DataFrame,
    leaves: DataFrame,
    equation: Equation,
    dt: float | Column,
    geometry: Geometry,
    codec: MortonCodec,
    layout: PatchLayout,
    nbr: DataFrame | None = None,
) -> DataFrame:
    """One step of a table of patches (``patch_rows``); a row a cell: patch_id, level, j, i and the fields.

    As each side takes its flux from its own halo, only uniform grids conserve to the last digit.
    Patches meet their neighbours' faces as arrays, and cells are exploded after the last shuffle.
    """
    fields, n = list(equation.fields), layout.sizes[0]
    dt = F.lit(dt) if isinstance(dt, float) else dt
    full = with_faces(patches, leaves, codec, layout, fields, nbr)

    def place(j: int, i: int) -> Column:
        """A cell, and where its value and those beside it stand in the array of a patch with its faces."""
        face = lambda d, t: n * n + d * n + t
        at = {
            "j": j,
            "i": i,
            "at": j * n + i,
            "l0": j * n + i - 1 if i else face(2, j),
            "r0": j * n + i + 1 if i < n - 1 else face(3, j),
            "l1": j * n + i - n if j else face(0, i),
            "r1": j * n + i + n if j < n - 1 else face(1, i),
        }
        return F.struct(*(F.lit(k).alias(name) for name, k in at.items()))

    places = F.array(*(place(j, i) for j in range(n) for i in range(n)))
    rows = full.select("patch_id", codec.level(F.col("patch_id")).alias("level"), *(F.col(f).alias(f"__{f}") for f in fields), F.explode(places).alias("p"))
    state = lambda at: F.struct(*(F.get(f"__{f}", F.col(f"p.{at}")).alias(f) for f in fields))
    near = rows.select("patch_id", "level", "p.j", "p.i", *(state(at).alias(f"__{at}") for at in ("at", "l0", "r0", "l1", "r1")))
    here = _state("__at.", fields)
    change = {f: F.lit(0.0) for f in fields}
    for axis in (0, 1):
        into = equation.flux(_state(f"__l{axis}.", fields), here, axis)
        out = equation.flux(here, _state(f"__r{axis}.", fields), axis)
        for f in fields:
            change[f] = change[f] + (out[f] - into[f]) * (dt / geometry.cell_size(F.col("level"), axis))
    return near.select("patch_id", "level", "j", "i", *((here[f] - change[f]).alias(f) for f in fields))


def peak_cell(cells: DataFrame, value: str, at: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The place of the largest value (the first in order of place on ties): one row, or one for each ``by``."""
    best = F.max_by(F.struct(*at), F.struct(F.col(value), *(-F.col(c) for c in at)))
    return cells.groupBy(*by).agg(best.alias("p"), F.max(value).alias(value)).select(*by, *(F.col(f"p.{c}").alias(c) for c in at), value)
