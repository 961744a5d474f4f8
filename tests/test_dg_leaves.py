"""DG terms on leaf sets: constants stay, integrals stay, smooth states converge, uniform levels agree with the grid."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import basis
from quadrille.functions.morton import MortonCodec
from quadrille.operators import dg, dg_leaves, tree

CODEC = MortonCodec(2, 6)


def _leaves(spark, level=2):
    """A balanced set of three levels, with hanging faces across the periodic edge too."""
    leaves = tree.uniform(spark, CODEC, level)
    for _ in range(2):
        picked = leaves.filter("x = 0 and y = 0").select("patch_id")
        wanted = tree.balance_refinement(picked, leaves, CODEC).checkpoint()
        leaves = tree.regrid_keys(leaves, wanted, wanted.filter("false"), CODEC).checkpoint()
    return leaves


def _cells(leaves, order, fields):
    """Fields as functions of (x, y) columns at the nodes."""
    edge = CODEC.side(F.col("level")) / CODEC.extent
    at = [(F.col("x") / CODEC.extent + edge * float(px), F.col("y") / CODEC.extent + edge * float(py)) for py, px in basis.tensor_points(order, 2)]
    return leaves.select("patch_id", *(F.array(*(f(x, y) for x, y in at)).alias(c) for c, f in fields.items())).checkpoint()


EULER = {
    "mx": lambda x, y: 0.3 + 0.1 * F.sin(2 * math.pi * x),
    "my": lambda x, y: 0.2 * F.cos(2 * math.pi * y),
    "rho": lambda x, y: 1.0 + 0.2 * F.sin(2 * math.pi * (x + y)),
    "e": lambda x, y: 2.5 + 0.3 * F.cos(2 * math.pi * x),
}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_constants_stay_and_integrals_stay(spark, order):
    leaves = _leaves(spark)
    assert {r.level for r in leaves.select("level").distinct().collect()} == {2, 3, 4}
    links = tree.neighbors(leaves, CODEC).checkpoint()
    names = list(EULER)
    still = _cells(leaves, order, {c: lambda x, y, v=v: x * 0 + v for c, v in zip(names, (0.3, -0.2, 1.1, 2.4), strict=True)})
    for row in dg_leaves.leaf_rhs(still, links, CODEC, order, dg.NodalEuler(), names).collect():
        assert np.abs([row[c] for c in names]).max() < 1e-11
    moving = dg_leaves.leaf_rhs(_cells(leaves, order, EULER), links, CODEC, order, dg.NodalEuler(), names)
    w = basis.tensor_weights(order, 2)
    rows = moving.join(leaves.select("patch_id", "level"), "patch_id").collect()
    assert len(rows) == leaves.count()
    for c in names:
        assert abs(sum(np.dot(w, r[c]) * 4.0**-r.level for r in rows)) < 1e-12
        assert max(np.abs(r[c]).max() for r in rows) > 1e-2


def test_linear_profiles_are_exact_inside(spark):
    """Where a linear state does not wrap, advection gives its slope, across hanging faces too."""
    leaves = _leaves(spark, 3)
    cells = _cells(leaves, 2, {"u": lambda x, y: 3 * x - 2 * y})
    got = dg_leaves.leaf_rhs(cells, tree.neighbors(leaves, CODEC), CODEC, 2, dg.LinearAdvection((1.0, 0.5)), ["u"])
    side = CODEC.side(F.col("level"))
    inside = got.join(leaves.filter((F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") + side < 64) & (F.col("y") + side < 64)), "patch_id").collect()
    assert {r.level for r in inside} >= {3, 4, 5}
    assert max(abs(v + 2.0) for r in inside for v in r.u) < 1e-10


def test_uniform_leaves_agree_with_the_grid(spark):
    level, order = 3, 2
    leaves = tree.uniform(spark, CODEC, level)
    cells = _cells(leaves, order, {"u": lambda x, y: F.sin(2 * math.pi * x) + F.cos(4 * math.pi * y)})
    linear = dg.LinearAdvection((1.0, -0.5))
    got = dg_leaves.leaf_rhs(cells, tree.neighbors(leaves, CODEC), CODEC, order, linear, ["u"]).join(leaves, "patch_id")
    grid = cells.join(leaves, "patch_id").select((F.col("x") / 8).cast("long").alias("x"), (F.col("y") / 8).cast("long").alias("y"), "u")
    want = {(r.x, r.y): r.u for r in dg.rhs(grid, dg.Config(order=order, extent=8), linear).collect()}
    for r in got.collect():
        assert np.allclose(r.u, want[r.x // 8, r.y // 8], atol=1e-10)
