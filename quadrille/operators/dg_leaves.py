"""Discontinuous-Galerkin terms on a quadtree: a leaf is a cell, and faces between levels hang.

Fluxes live on mortars, the faces of the finer side: the coarse trace is interpolated to the half
that a finer neighbour covers, the flux is worked out there once for both sides, and the coarse side
takes it back by the transposed interpolation, so nothing is lost between levels.  Cells are
``patch_id`` and an array for each component, row-major over order x order nodes, the last along x.

Everything is a sum of columns written out for the order at hand, which Spark compiles; tables of the
basis become numbers in it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import basis
from ..functions.morton import MortonCodec

#: Direction 2 * dim + positive; dimension 1 is x (axis 0 of an equation).
DIRS = range(4)


def _axis(direction: int) -> int:
    return 1 - direction // 2


def weighted(weights: Sequence[float], columns: Sequence[Column]) -> Column:
    """A sum of columns with fixed weights, those of weight 0 left out."""
    out = None
    for w, c in zip(weights, columns, strict=True):
        if w:
            term = c if w == 1 else c * F.lit(float(w))
            out = term if out is None else out + term
    return F.lit(0.0) if out is None else out


def trace_rows(order: int, direction: int) -> np.ndarray:
    """[place on the face, node]: the trace of a cell on its face of a direction."""
    kernel, out = basis.face_values(order)[direction % 2], np.zeros((order, order * order))
    for along in range(order):
        for across in range(order):
            node = along * order + across if _axis(direction) == 0 else across * order + along
            out[along, node] = kernel[across]
    return out


def halves(order: int) -> np.ndarray:
    """[half, place on it, place on the whole face]: a coarse trace at the nodes of each half."""
    nodes, _ = basis.gauss(order)
    return np.array([[basis.barycentric(nodes, (x + s) / 2) for x in nodes] for s in (0, 1)])


def traces(cells: DataFrame, order: int, components: Sequence[str]) -> DataFrame:
    """patch_id and ``t``: for each direction a struct of the components' traces, arrays of ``order`` values."""
    nodes = {c: [F.get(F.col(c), F.lit(k)) for k in range(order * order)] for c in components}
    faces = [
        F.struct(*(F.array(*(weighted(row, nodes[c]) for row in trace_rows(order, d))).alias(c) for c in components)) for d in DIRS
    ]
    return cells.select("patch_id", F.array(*faces).alias("t"))


def _half(codec: MortonCodec, key: Column) -> Column:
    """Which half of its parent's face across ``dir`` a leaf touches: its offset along the face."""
    offset = codec.offset_of(key)
    return F.when(F.col("dir") < 2, offset.bitwiseAND(1)).otherwise(F.shiftright(offset, 1).bitwiseAND(1))


def mortar_terms(cells: DataFrame, links: DataFrame, codec: MortonCodec, order: int, equation, components: Sequence[str]) -> DataFrame:
    """patch_id and, for each component and node, the sum over faces of the lifted flux (``__f0u``, ...), per length of the leaf's edge.

    A neighbour's trace meets a face by one join on its key, the own one by another; sums are partial
    before they are sent.
    """
    sent = traces(cells, order, components)
    half = F.when(F.col("relation") == "coarser", _half(codec, F.col("patch_id"))).otherwise(_half(codec, F.col("n_id")))
    met = (
        links.select("patch_id", "dir", "relation", "n_id")
        .join(sent.select(F.col("patch_id").alias("n_id"), F.col("t").alias("__t")), "n_id")
        .select("patch_id", "dir", "relation", half.alias("half"), F.get("__t", F.col("dir").bitwiseXOR(F.lit(1))).alias("there"))
        .join(sent, "patch_id")
        .select("patch_id", "dir", "relation", "half", "there", F.get("t", F.col("dir")).alias("here"))
    )
    _, w = basis.gauss(order)
    h = halves(order)

    def values(side: str, c: str, interpolated: Column) -> list[Column]:
        plain = [F.get(F.col(f"{side}.{c}"), F.lit(q)) for q in range(order)]
        low, high = ([weighted(row, plain) for row in h[s]] for s in (0, 1))
        return [F.when(interpolated & (F.col("half") == 0), a).when(interpolated, b).otherwise(p) for a, b, p in zip(low, high, plain, strict=True)]

    coarse = F.col("relation") == "finer"  # the own side is the coarse one
    inner = {c: values("here", c, coarse) for c in components}
    outer = {c: values("there", c, F.col("relation") == "coarser") for c in components}
    points = met.select(
        "patch_id", "dir", "relation", "half", *(x[c][q].alias(f"{s}{q}{c}") for s, x in (("a", inner), ("b", outer)) for c in components for q in range(order))
    )
    sign = F.when(F.col("dir") % 2 == 1, 1.0).otherwise(-1.0)
    flux: dict[str, list[Column]] = {c: [] for c in components}
    for q in range(order):
        a, b = ({c: F.col(f"{s}{q}{c}") for c in components} for s in "ab")
        fa, fb, top = {}, {}, None
        across_x = F.col("dir") >= 2
        per_axis = [(equation.point_flux(a, x), equation.point_flux(b, x), F.greatest(equation.point_speed(a, x), equation.point_speed(b, x))) for x in (0, 1)]
        top = F.when(across_x, per_axis[0][2]).otherwise(per_axis[1][2])
        for c in components:
            fa[c], fb[c] = (F.when(across_x, per_axis[0][k][c]).otherwise(per_axis[1][k][c]) for k in (0, 1))
            flux[c].append((fa[c] + fb[c]) * 0.5 * sign + (a[c] - b[c]) * top * 0.5)
    fluxes = points.select("patch_id", "dir", "relation", "half", *(f.alias(f"f{q}{c}") for c in components for q, f in enumerate(flux[c])))
    back = [0.5 * w[:, None] * h[s] for s in (0, 1)]
    weights = {}
    for c in components:
        f = [F.col(f"f{q}{c}") for q in range(order)]
        weights[c] = [
            F.when(coarse & (F.col("half") == 0), weighted(back[0][:, i], f)).when(coarse, weighted(back[1][:, i], f)).otherwise(f[i] * float(w[i]))
            for i in range(order)
        ]
    lifted = fluxes.select("patch_id", "dir", *(x.alias(f"w{i}{c}") for c in components for i, x in enumerate(weights[c])))
    sums = []
    for c in components:
        own = [F.col(f"w{i}{c}") for i in range(order)]
        for k in range(order * order):
            by_face = F.lit(0.0)
            for d in DIRS:
                by_face = F.when(F.col("dir") == d, weighted(trace_rows(order, d)[:, k], own)).otherwise(by_face)
            sums.append(F.sum(by_face).alias(f"__f{k}{c}"))
    return lifted.groupBy("patch_id").agg(*sums)


def volume_terms(order: int, equation, nodes: dict[str, list[Column]]) -> dict[str, list[Column]]:
    """For each component and node, the volume integral per length of the leaf's edge."""
    d, (_, w) = basis.derivative_matrix(order), basis.gauss(order)
    n = order * order
    per_node = [[equation.point_flux({c: v[k] for c, v in nodes.items()}, axis) for k in range(n)] for axis in (0, 1)]
    out = {}
    for c in nodes:
        out[c] = []
        for j in range(order):
            for i in range(order):
                along_x = weighted([d[i, m] * w[m] * w[j] for m in range(order)], [per_node[0][j * order + m][c] for m in range(order)])
                along_y = weighted([d[j, m] * w[m] * w[i] for m in range(order)], [per_node[1][m * order + i][c] for m in range(order)])
                out[c].append(along_x + along_y)
    return out


def leaf_rhs(cells: DataFrame, links: DataFrame, codec: MortonCodec, order: int, equation, components: Sequence[str]) -> DataFrame:
    """patch_id and, for each component, the time derivative at the nodes of every leaf of the unit square.

    ``links`` are the leaves' neighbours (``tree.neighbors``) under 2:1 balance.  One evaluation; the
    integral of each component over the domain does not change.
    """
    faces = mortar_terms(cells, links, codec, order, equation, components)
    n = order * order
    _, w = basis.gauss(order)
    nodes = {c: [F.get(F.col(c), F.lit(k)) for k in range(n)] for c in components}
    volume = volume_terms(order, equation, nodes)
    edge = codec.side(codec.level(F.col("patch_id"))) / codec.extent
    rates = {
        c: F.array(*((volume[c][k] - F.col(f"__f{k}{c}")) / (edge * float(w[k // order] * w[k % order])) for k in range(n))) for c in components
    }
    return cells.select("patch_id", *components).join(faces, "patch_id").select("patch_id", *(r.alias(c) for c, r in rates.items()))
