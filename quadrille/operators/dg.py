"""Discontinuous-Galerkin cells: nodal arrays, volume and face terms, time integrators.

A cell table is ``x, y`` (periodic grid) and one array per component, row-major over order x order
nodes, the last index along x; columns ``by`` tell the grids of a table of many apart.  A derivative sends cells to the blocks beside
theirs: one shuffle.  A time step gathers blocks with a margin as wide as it has stages, so all its stages take one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import basis
from ..functions import tensors as T


@dataclass(frozen=True)
class Config:
    """What the scheme is made of."""

    order: int = 2
    rank: int = 2
    extent: int = 64
    components: tuple[str, ...] = ("u",)

    @property
    def shape(self) -> tuple[int, ...]:
        return (self.order,) * self.rank

    @property
    def edge(self) -> float:
        return 1.0 / self.extent


class LinearAdvection:
    """Every component moves with ``velocity`` along each axis."""

    def __init__(self, velocity: Sequence[float] = (1.0, 1.0)):
        self.velocity = tuple(velocity)

    def flux(self, state: dict[str, Column], axis: int) -> dict[str, Column]:
        return {c: T.multiply(a, self.velocity[axis]) for c, a in state.items()}

    def speed(self, state: dict[str, Column], axis: int) -> Column:
        return F.lit(abs(self.velocity[axis]))

    def point_flux(self, state: dict[str, Column], axis: int) -> dict[str, Column]:
        """The flux of one node's values, columns or numpy arrays."""
        return {c: v * self.velocity[axis] for c, v in state.items()}

    def point_speed(self, state: dict[str, Column], axis: int) -> Column:
        return F.lit(abs(self.velocity[axis]))

    def array_speed(self, state: dict[str, np.ndarray], axis: int) -> float:
        """``point_speed`` of numpy arrays."""
        return abs(self.velocity[axis])


class NodalEuler:
    """Euler equations at nodes; components mx, my, rho, e."""

    components = ("mx", "my", "rho", "e")

    def __init__(self, gamma: float = 1.4):
        self.gamma = gamma

    def pressure(self, s: dict[str, Column]) -> Column:
        """At every node."""
        momentum = T.add(T.multiply(s["mx"], s["mx"]), T.multiply(s["my"], s["my"]))
        return T.multiply(T.subtract(s["e"], T.multiply(T.divide(momentum, s["rho"]), 0.5)), self.gamma - 1)

    def energy(self, momenta: Sequence[Column], rho: Column, p: Column) -> Column:
        """Total energy of one node."""
        return p / (self.gamma - 1) + sum((m * m for m in momenta), F.lit(0.0)) * 0.5 / rho

    def flux(self, s: dict[str, Column], axis: int) -> dict[str, Column]:
        p, own = self.pressure(s), ("mx", "my")[axis]
        along = T.divide(s[own], s["rho"])
        out = {m: T.multiply(s[m], along) for m in ("mx", "my")}
        out[own] = T.add(out[own], p)
        return out | {"rho": s[own], "e": T.multiply(T.add(s["e"], p), along)}

    def speed(self, s: dict[str, Column], axis: int) -> Column:
        """|u| + c at the first node."""
        return self.point_speed({k: F.get(v, F.lit(0)) for k, v in s.items()}, axis)

    def point_pressure(self, s: dict[str, Column]) -> Column:
        kinetic = (s["mx"] * s["mx"] + s["my"] * s["my"]) * 0.5 / s["rho"]
        return (s["e"] - kinetic) * (self.gamma - 1)

    def point_flux(self, s: dict[str, Column], axis: int) -> dict[str, Column]:
        """The flux of one node's values, columns or numpy arrays."""
        p, own = self.point_pressure(s), ("mx", "my")[axis]
        along = s[own] / s["rho"]
        out = {m: s[m] * along for m in ("mx", "my")}
        out[own] = out[own] + p
        return out | {"rho": s[own], "e": (s["e"] + p) * along}

    def point_speed(self, s: dict[str, Column], axis: int) -> Column:
        """|u| + c."""
        return F.abs(s[("mx", "my")[axis]] / s["rho"]) + F.sqrt(self.point_pressure(s) * self.gamma / s["rho"])

    def array_speed(self, s: dict[str, np.ndarray], axis: int) -> np.ndarray:
        """``point_speed`` of numpy arrays."""
        return np.abs(s[("mx", "my")[axis]] / s["rho"]) + np.sqrt(self.point_pressure(s) * self.gamma / s["rho"])


def project(config: Config, f: Callable[[Column, Column], Column], corner_x: Column, corner_y: Column) -> Column:
    """f(x, y) at the nodes of a cell with the given corner."""
    points = basis.tensor_points(config.order, 2)
    return F.array(*(f(corner_x + F.lit(float(px)) * config.edge, corner_y + F.lit(float(py)) * config.edge) for py, px in points))


def evaluate(config: Config, dofs: Column, point: Sequence[float]) -> Column:
    """The interpolant at a point (y, x) of the reference cell."""
    return T.dot(dofs, basis.literal(basis.evaluation_row(config.order, np.array(point))))


def cell_average(dofs: Column, n: int) -> Column:
    """Mean over nodes."""
    return F.aggregate(dofs, F.lit(0.0), lambda a, x: a + x) / F.lit(float(n))


def indicator(momenta: Sequence[Column], rho: Column, n: int) -> Column:
    """Largest spread of a momentum over nodes, relative to the mean density."""
    spread = [F.array_max(m) - F.array_min(m) for m in momenta]
    top = F.greatest(*spread) if len(spread) > 1 else spread[0]
    return top / (F.abs(cell_average(rho, n)) + F.lit(1e-10))


def patch_decisions(cells: DataFrame, refine_above: Column | float, coarsen_below: Column | float) -> DataFrame:
    """patch_id, status from cells (patch_id, indicator): any above refines, all below coarsens."""
    agg = cells.groupBy("patch_id").agg(
        F.bool_or(F.col("indicator") > refine_above).alias("any"), F.bool_and(F.col("indicator") < coarsen_below).alias("all")
    )
    status = F.when(F.col("any"), "refine").when(F.col("all"), "coarsen").otherwise("stable")
    return agg.select("patch_id", status.alias("status"))


def prolong_dofs(config: Config, dofs: Column, child: int) -> Column:
    """Nodes of a child from the interpolant of its parent."""
    matrix = basis.prolongation(config.order, config.rank)[child]
    return F.array(*(T.dot(dofs, basis.literal(row)) for row in matrix))


def restrict_dofs(config: Config, children: Sequence[Column]) -> Column:
    """Nodes of a parent, each from the interpolant of the child that holds it."""
    return F.array(*(T.dot(children[c], basis.literal(row)) for c, row in basis.restriction(config.order, config.rank)))


def volume_term(config: Config, fluxes: Sequence[Column]) -> Column:
    """Sum over axes of the derivative matrix applied to flux times mass, scaled to the cell."""
    mass = basis.literal(basis.tensor_weights(config.order, config.rank))
    d = basis.literal(basis.derivative_matrix(config.order))
    out = None
    for axis, flux in enumerate(fluxes):
        term = T.apply_matrix(T.hadamard(flux, mass), d, config.shape, config.rank - 1 - axis)
        out = term if out is None else T.add(out, term)
    return T.multiply(out, config.edge ** (config.rank - 1))


def to_face(config: Config, dofs: Column, axis: int, upper: bool) -> Column:
    """Values on a face, row-major over the other axes."""
    kernel = basis.literal(basis.face_values(config.order)[int(upper)])
    return T.contract(dofs, kernel, config.shape, config.rank - 1 - axis)


def rusanov(inner: Column, outer: Column, flux_in: Column, flux_out: Column, speed: Column, sign: int, area: float) -> Column:
    """Numerical flux out of a face of outward sign, times the face's area."""
    mean = T.multiply(T.add(flux_in, flux_out), 0.5 * sign)
    jump = F.transform(T.subtract(inner, outer), lambda x: x * speed * 0.5)
    return T.multiply(T.add(mean, jump), area)


def lift(config: Config, flux: Column, axis: int, upper: bool) -> Column:
    """A face's numerical flux to the nodes of the cell."""
    weighted = T.hadamard(flux, basis.literal(basis.tensor_weights(config.order, config.rank - 1)))
    kernel = basis.literal(basis.face_values(config.order)[int(upper)])
    return T.outer(weighted, kernel) if axis == 0 else T.outer(kernel, weighted)


FACES = tuple((axis, upper) for axis in (0, 1) for upper in (False, True))


#: Cells of a block along an axis at most.
BLOCK = 32


def _beside(cells: DataFrame, config: Config, keep: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``cells`` with the components of the four cells beside each, structs ``__n00`` (left) to ``__n11`` (above).

    The grid is cut into blocks; a cell at a block's edge also goes to the block beside it, so one shuffle by
    block brings neighbours together, and windows run along the lines of a block only.
    """
    n = config.extent
    size = max(b for b in range(1, min(BLOCK, n) + 1) if n % b == 0)
    axes, blocks = ("x", "y"), ("__bx", "__by")
    home = [F.floor(F.col(a) / size).cast("long") for a in axes]
    local = [(F.col(a) % size).cast("long") for a in axes]

    def copy(axis: int | None, step: int) -> Column:
        to = [F.pmod(h + step, F.lit(n // size)) if i == axis else h for i, h in enumerate(home)]
        at = [v - step * size if i == axis else v for i, v in enumerate(local)]
        row = F.struct(
            *(c.alias(m) for c, m in zip(to, blocks, strict=True)), *(c.alias(f"__l{m}") for c, m in zip(at, axes, strict=True)), F.lit(axis is None).alias("__inside")
        )
        return row if axis is None else F.when(local[axis] == (0 if step < 0 else size - 1), row)

    copies = F.filter(F.array(copy(None, 0), *(copy(a, step) for a in (0, 1) for step in (-1, 1))), lambda c: c.isNotNull())
    work = cells.select(*by, "x", "y", *keep, F.explode(copies).alias("__c")).select(*by, "x", "y", *keep, "__c.*").repartition(*by, *blocks)
    own = F.struct(*config.components)
    for axis, a in enumerate(axes):
        line = Window.partitionBy(*by, *blocks, f"__l{axes[1 - axis]}").orderBy(f"__l{a}")
        work = work.withColumns({f"__n{axis}0": F.lag(own).over(line), f"__n{axis}1": F.lead(own).over(line)})
    return work.filter("__inside").select(*by, "x", "y", *keep, *(f"__n{a}{int(up)}" for a, up in FACES))


def _with_slopes(cells: DataFrame, config: Config, equation, carry: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """``by``, x, y, the components, ``carry``, and the time derivative of each component under ``__d``.

    A cell gets the components of the four beside it (one shuffle), and works out its volume term and both
    sides of its faces.  The speed at a face is the larger of the two cells'.
    """
    names = config.components
    work = _beside(cells, config, (*names, *carry), by)

    def side(state: dict[str, Column], axis: int, upper: bool, name: str) -> list[Column]:
        """Values, fluxes and speed on one face of a cell."""
        fluxes = equation.flux(state, axis)
        return [
            *(to_face(config, state[c], axis, upper).alias(f"{name}u{c}") for c in names),
            *(to_face(config, fluxes[c], axis, upper).alias(f"{name}f{c}") for c in names),
            equation.speed(state, axis).alias(f"{name}speed"),
        ]

    own = {c: F.col(c) for c in names}
    found: list[Column] = []
    for axis, upper in FACES:
        there = {c: F.col(f"__n{axis}{int(upper)}.{c}") for c in names}
        found += side(own, axis, upper, f"__s{axis}{int(upper)}") + side(there, axis, not upper, f"__t{axis}{int(upper)}")
    fluxes = [equation.flux(own, a) for a in (0, 1)]
    inner = [(volume_term(config, [f[c] for f in fluxes]) if config.order > 1 else T.fill(1, 0.0)).alias(f"__v{c}") for c in names]
    work = work.select(*by, "x", "y", *names, *carry, *inner, *found)
    inverse = basis.literal(basis.inverse_mass(config.order, config.rank) / config.edge**config.rank)
    out = {}
    for c in names:
        total = F.col(f"__v{c}")
        for axis, upper in FACES:
            mine, there = f"__s{axis}{int(upper)}", f"__t{axis}{int(upper)}"
            flux = rusanov(
                F.col(f"{mine}u{c}"),
                F.col(f"{there}u{c}"),
                F.col(f"{mine}f{c}"),
                F.col(f"{there}f{c}"),
                F.greatest(F.col(f"{mine}speed"), F.col(f"{there}speed")),
                1 if upper else -1,
                config.edge ** (config.rank - 1),
            )
            total = T.subtract(total, lift(config, flux, axis, upper))
        out[c] = T.hadamard(total, inverse)
    return work.select(*by, "x", "y", *names, *carry, *(out[c].alias(f"__d{c}") for c in names))


def rhs(cells: DataFrame, config: Config, equation, by: Sequence[str] = ()) -> DataFrame:
    """Time derivative of all components of every cell: x, y and the arrays."""
    return _with_slopes(cells, config, equation, by=by).select(*by, "x", "y", *(F.col(f"__d{c}").alias(c) for c in config.components))


#: Shu-Osher form of the integrators: each stage is (weight of the start, weight of stage + dt * rhs).
INTEGRATORS = {
    "euler": ((0.0, 1.0),),
    "ssprk2": ((0.0, 1.0), (0.5, 0.5)),
    "ssprk3": ((0.0, 1.0), (0.75, 0.25), (1 / 3, 2 / 3)),
}


def advance(cells: DataFrame, config: Config, equation, dt: float, integrator: str = "ssprk2", by: Sequence[str] = ()) -> DataFrame:
    """One time step of whole grids; all stages take one shuffle, which gathers blocks with margins.

    An equation without ``point_flux`` and ``array_speed`` is advanced cell by cell.
    """
    if not (hasattr(equation, "point_flux") and hasattr(equation, "array_speed")):
        return advance_cells(cells, config, equation, dt, integrator, by)
    n, stages = config.extent, INTEGRATORS[integrator]
    size = PATCH if PATCH + 2 * len(stages) <= n else n
    margin = 0 if size == n else len(stages)
    keys, arrays = [*by, "__bx", "__by"], list(config.components)
    work = cells.select(*by, "x", "y", *(F.col(c).cast("array<double>").alias(c) for c in arrays))
    for a in ("x", "y"):
        work = work.withColumn(f"__b{a}", _blocks_of(F.col(a), n, size, margin))
    gathered = work.repartition(*keys).sortWithinPartitions(*keys)
    fields = [*(work.schema[c] for c in (*by, "x", "y")), *(StructField(c, ArrayType(DoubleType())) for c in arrays)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; a block that may go on in the next batch waits for it."""
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            starts = _starts_of_blocks(table, keys)
            held = table.slice(starts[-1])
            if len(starts) > 1:
                yield _advance_blocks(table.slice(0, starts[-1]), starts, config, equation, dt, stages, size, margin, by)
        if held is not None:
            yield _advance_blocks(held, np.array([0, held.num_rows]), config, equation, dt, stages, size, margin, by)

    return gathered.mapInArrow(run, StructType(fields))


#: Cells along an axis of a block that goes through a time step (the last block may have fewer); a grid that is hardly
#: larger is one block and needs no margin.
PATCH = 64


def _blocks_of(at: Column, n: int, size: int, margin: int) -> Column:
    """Exploded: the blocks along an axis of which a cell is part, or is within the margin."""
    home = F.floor(at / size).cast("long")
    if not margin:
        return home
    around = -(-margin // size) + (n % size > 0)
    near = [F.pmod(home + step, F.lit(-(-n // size))).cast("long") for step in range(-around, around + 1)]
    inside = lambda b: F.pmod(at - b * size + margin, F.lit(n)) < F.least(F.lit(size), n - b * size) + 2 * margin
    return F.explode(F.array_distinct(F.array_compact(F.array(*(F.when(inside(b), b) for b in near)))))


def _starts_of_blocks(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Rows at which another block begins, the first row included."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        code = table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _array_slopes(state: dict[str, np.ndarray], config: Config, equation) -> dict[str, np.ndarray]:
    """Time derivatives of [node along y, node along x, block, y, x]; the terms are those of ``_with_slopes``.

    Neighbours are taken round the end of a block, which is right for one that is its whole grid; in others it spoils one more
    ring of the margin each time.
    """
    n, area = config.order, config.edge ** (config.rank - 1)
    mass, inverse = (np.reshape(w, (n, n, 1, 1, 1)) for w in (basis.tensor_weights(n, 2), basis.inverse_mass(n, 2) / config.edge**config.rank))
    weights, d = basis.tensor_weights(n, 1), basis.derivative_matrix(n)
    total = {c: np.zeros_like(v) for c, v in state.items()}
    for axis, (onto, along, lifted) in enumerate((("q,pq...->p...", "oq,pq...->po...", "q,p...->pq..."), ("p,pq...->q...", "op,pq...->oq...", "p,q...->pq..."))):
        flux = equation.point_flux(state, axis)
        speed = np.asarray(equation.array_speed({c: v[0, 0] for c, v in state.items()}, axis))
        back = lambda v, step, axis=axis: np.roll(v, step, -1 - axis)
        # Of the upper face of every cell, then of the lower one: that of the cell before it.
        fastest = speed if speed.ndim == 0 else np.maximum(speed, back(speed, -1))
        low, high = basis.face_values(n)
        for c, v in state.items():
            if n > 1:
                total[c] += np.einsum(along, d, flux[c] * mass) * area
            inner, outer = np.einsum(onto, high, v), back(np.einsum(onto, low, v), -1)
            there = np.einsum(onto, high, flux[c]) + back(np.einsum(onto, low, flux[c]), -1)
            out = (there * 0.5 + (inner - outer) * fastest * 0.5) * area * weights.reshape(-1, 1, 1, 1)
            total[c] -= np.einsum(lifted, high, out) - np.einsum(lifted, low, back(out, 1))
    return {c: v * inverse for c, v in total.items()}


def _advance_blocks(
    table: pa.Table, starts: np.ndarray, config: Config, equation, dt: float, stages: Sequence[tuple], size: int, margin: int, by: Sequence[str]
) -> pa.RecordBatch:
    """The cells inside some whole blocks after a time step; a cell that is not there counts as NaN."""
    n, side = config.order, size + 2 * margin
    counts = np.diff(np.append(starts[starts < table.num_rows], table.num_rows))
    block = np.repeat(np.arange(len(counts)), counts)
    corners = {a: table[f"__b{a}"].to_numpy() * size for a in ("x", "y")}
    x, y = ((table[a].to_numpy() - corner + margin) % config.extent for a, corner in corners.items())
    state = {}
    for c in config.components:
        column = table[c].combine_chunks()
        values = column.flatten().to_numpy(zero_copy_only=False)
        if column.null_count or (np.diff(column.offsets.to_numpy()) != n * n).any():
            raise ValueError(f"{c} must be arrays of {n * n} numbers")
        state[c] = np.full((n, n, len(counts), side, side), np.nan)
        state[c][:, :, block, y, x] = values.reshape(-1, n, n).transpose(1, 2, 0)
    first = state
    with np.errstate(all="ignore"):
        for keep, new in stages:
            slopes = _array_slopes(state, config, equation)
            state = {c: (v + slopes[c] * dt) * new + (first[c] * keep if keep else 0.0) for c, v in state.items()}
    inside = np.ones(table.num_rows, bool)
    for at, corner in ((x, corners["x"]), (y, corners["y"])):
        inside &= (at >= margin) & (at < margin + np.minimum(size, config.extent - corner))
    kept = table.select([*by, "x", "y"]).filter(pa.array(inside)).combine_chunks()
    at = block[inside], y[inside], x[inside]
    ends = np.arange(len(at[0]) + 1, dtype="i4") * (n * n)
    lists = [pa.ListArray.from_arrays(ends, state[c][:, :, *at].transpose(2, 0, 1).ravel()) for c in config.components]
    columns = [kept[c].combine_chunks() for c in kept.column_names]
    return pa.RecordBatch.from_arrays([*columns, *lists], names=[*kept.column_names, *config.components])


def advance_cells(cells: DataFrame, config: Config, equation, dt: float, integrator: str = "ssprk2", by: Sequence[str] = ()) -> DataFrame:
    """``advance`` at cell grain; each stage is one shuffle, and the state at the start travels in the row."""
    names = config.components
    state = cells.select(*by, "x", "y", *names, *(F.col(c).alias(f"__start_{c}") for c in names))
    start = [f"__start_{c}" for c in names]
    for keep, new in INTEGRATORS[integrator]:
        slope = _with_slopes(state, config, equation, start, by)
        stage = {c: T.multiply(T.add(F.col(c), T.multiply(F.col(f"__d{c}"), dt)), new) for c in names}
        if keep:
            stage = {c: T.add(v, T.multiply(F.col(f"__start_{c}"), keep)) for c, v in stage.items()}
        state = slope.select(*by, "x", "y", *(v.alias(c) for c, v in stage.items()), *start)
    return state.select(*by, "x", "y", *names)


def total(cells: DataFrame, config: Config, component: str) -> DataFrame:
    """Integral of a component over the domain."""
    weights = basis.literal(basis.tensor_weights(config.order, config.rank))
    return cells.agg((F.sum(T.dot(F.col(component), weights)) * config.edge**config.rank).alias("total"))


def nodes(config: Config) -> int:
    return prod(config.shape)
