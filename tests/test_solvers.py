"""Time stepping: conservation, the moving pulse, patch grain, DG tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import basis, numeric, physics
from quadrille.functions.geometry import Geometry
from quadrille.functions.morton import MortonCodec
from quadrille.operators import blocks, dg, fvm, intergrid, tree
from quadrille.operators.layout import PatchLayout
from quadrille.plans import loops
from quadrille.sources import tables as S


def test_mass_is_conserved(spark, sf_dir):
    cells = S.grid(spark, sf_dir)
    end = loops.run_uniform(cells, physics.Advection((1.0, 0.5)), (1 / 64, 1 / 64), 64, t_end=0.01)
    total = lambda c: c.agg(F.sum("u")).first()[0]
    assert abs(total(end) - total(cells)) < 1e-6


def test_pulse_arrives(spark):
    """A bump at (0.2, 0.2) moves with (1, 0.5); after 0.5 its peak is at (0.7, 0.45), within a cell."""
    n = 20
    center = [(F.col(c) + 0.5) / n for c in ("x", "y")]
    cells = S.square(spark, n).select("x", "y", physics.gaussian(center, (0.2, 0.2), 0.005).alias("u"))
    out = blocks.run_blocks(cells, blocks.AdvectionKernel(), n, 0.4 / n, round(0.5 * n / 0.4), n=10, per_round=5)
    peak = fvm.peak_cell(out, "u", ["x", "y"]).first()
    assert abs((peak.x + 0.5) / n - 0.7) <= 1 / n + 1e-9 and abs((peak.y + 0.5) / n - 0.45) <= 1 / n + 1e-9


def test_adaptive_pulse(spark):
    codec, layout = MortonCodec(2, 4), PatchLayout((4, 4), 1)
    geometry = Geometry((1.0, 1.0), (4, 4), 4)
    leaves = tree.uniform(spark, codec, 2)
    level = F.col("level")
    at = [geometry.cell_center(F.col(c), level, F.col(k), a) for a, (c, k) in enumerate((("x", "i"), ("y", "j")))]
    cells = S.initialize(leaves, (4, 4), {"u": physics.gaussian(at, (0.25, 0.25), 0.02)}).select("patch_id", "level", "j", "i", "u")

    def criterion(c):
        return intergrid.threshold_flags(c, F.col("u"), 0.3, 0.05, 1, 4).select("patch_id", "status")

    seen = []
    end, grid, report = loops.run_refined(
        cells, leaves, physics.Advection(), geometry, codec, layout, 0.06, criterion, cfl=0.4, regrid_every=2, output=lambda *a: seen.append(a[0]), output_every=2
    )
    assert report.steps >= 2 and report.regrids >= 1 and seen
    levels = {r.level for r in grid.select("level").distinct().collect()}
    assert len(levels) > 1 and sum(4.0**-r.level for r in grid.collect()) == 1.0
    assert end.count() == 16 * grid.count()


@pytest.mark.parametrize("kernel", [blocks.AdvectionKernel(), blocks.EulerKernel()])
def test_blocks_equal_single_steps(spark, sf_dir, kernel):
    if kernel.fields == ("u",):
        cells, equation = S.grid(spark, sf_dir), physics.Advection((1.0, 0.5))
    else:
        equation = physics.Euler(2)
        cons = equation.conservative({c: F.col(c) for c in ("rho", "vx", "vy", "p")})
        cells = S.primitive_grid(spark, sf_dir).select("x", "y", *(c.alias(k) for k, c in cons.items()))
    fast = blocks.run_blocks(cells, kernel, 64, 0.002, 3, n=16, per_round=2).toPandas().sort_values(["x", "y"])
    slow = cells
    for _ in range(3):
        slow = fvm.uniform_step(slow, equation, 0.002, (1 / 64, 1 / 64), 64)
    slow = slow.toPandas().sort_values(["x", "y"])
    for f in kernel.fields:
        assert np.allclose(fast[f].to_numpy(), slow[f].to_numpy(), rtol=1e-12, atol=1e-12)


def test_three_dimensions(spark):
    rows = S.square(spark, 8).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(3)))).filter("x < 4 and y < 4")
    gas = physics.Euler(3)
    prim = {"rho": F.lit(1.0), "vx": F.lit(0.1), "vy": F.lit(0.0), "vz": F.col("z") * 0.0, "p": 1 + F.col("x") * 0.01}
    cells = rows.select("x", "y", "z", *(c.alias(k) for k, c in gas.conservative(prim).items()))
    out = fvm.uniform_step(cells, gas, 0.001, (0.25,) * 3, 4)
    for f in gas.fields:
        assert abs(out.agg(F.sum(f)).first()[0] - cells.agg(F.sum(f)).first()[0]) < 1e-9


@pytest.mark.parametrize("order", range(1, 9))
def test_basis(order):
    nodes, weights = basis.gauss(order)
    assert abs(weights.sum() - 1) < 1e-12
    for x in (0.3, 0.4, float(nodes[0])):
        values = basis.barycentric(nodes, x)
        assert abs(values.sum() - 1) < 1e-12
        assert np.allclose(values, [basis.lagrange(nodes, i, x) for i in range(order)])
        assert abs(basis.barycentric_derivative(nodes, x).sum()) < 1e-8
    f = lambda x, y: x ** (order - 1) + y
    if order > 1:
        points = basis.tensor_points(order, 2)
        dofs = np.array([f(x, y) for y, x in points])
        assert abs(basis.evaluation_row(order, np.array([0.2, 0.7])) @ dofs - f(0.7, 0.2)) < 1e-10
        assert np.allclose(basis.derivative_matrix(order).T @ nodes, 1)


def test_dg_conserves_and_is_still_on_constants(spark):
    config = dg.Config(order=3, extent=4, components=dg.NodalEuler.components)
    rho = F.array(*(F.lit(1.0 + 0.01 * k) for k in range(9)))
    flat = F.array_repeat(F.lit(0.1), 9)
    cells = S.square(spark, 4).select("x", "y", flat.alias("mx"), flat.alias("my"), rho.alias("rho"), F.array_repeat(F.col("x") * 0.1 + 2.5, 9).alias("e"))
    slope = dg.rhs(cells, config, dg.NodalEuler())
    for c in config.components:
        assert abs(dg.total(slope, config, c).first().total) < 1e-9
    still = S.square(spark, 4).select("x", "y", *(F.array_repeat(F.lit(v), 9).alias(c) for c, v in zip(config.components, (0.1, 0.2, 1.0, 3.0), strict=True)))
    row = dg.rhs(still, config, dg.NodalEuler()).first()
    assert max(abs(v) for c in config.components for v in row[c]) < 1e-9


def test_dg_sine_wave_order(spark):
    """Third-order nodes follow a sine wave; halving cells cuts the error well."""
    errors = []
    for n in (4, 8):
        config = dg.Config(order=3, extent=n)
        wave = lambda t, config=config: dg.project(config, lambda x, y: physics.sine_waves(x, y, t)[0], F.col("x") * config.edge, F.col("y") * config.edge)
        cells = S.square(spark, n).select("x", "y", wave(0.0).alias("u"))
        end = dg.advance(cells, config, dg.LinearAdvection((1.0, 1.0)), 0.002, "ssprk3")
        exact = S.square(spark, n).select("x", "y", wave(0.002).alias("w"))
        both = end.join(exact, ["x", "y"]).toPandas()
        errors.append(np.abs(np.stack(both.u) - np.stack(both.w)).max())
    assert errors[1] < errors[0] / 3


def test_random_columns(spark):
    rows = spark.range(20000)
    got = rows.select(
        numeric.uniform(1, 2, 4).alias("u"),
        numeric.normal(2, 5, 2).alias("n"),
        numeric.integers(3, 1, 6).alias("i"),
        numeric.exponential(4, 2.0).alias("e"),
        numeric.bernoulli(5, 0.3).cast("int").alias("b"),
        numeric.geometric(6, 0.5).alias("g"),
        numeric.discrete(7, [1, 1, 2]).alias("d"),
        numeric.binomial(8, 10, 0.5).alias("bin"),
        numeric.gamma(9, 3).alias("gam"),
        numeric.students_t(10, 30).alias("t"),
        numeric.piecewise_linear(11, [0.0, 1.0], [0.0, 2.0]).alias("p"),
    ).toPandas()
    want = {"u": 3, "n": 5, "i": 3.5, "e": 0.5, "b": 0.3, "g": 1, "d": 1.25, "bin": 5, "gam": 3, "t": 0, "p": 2 / 3}
    for c, mean in want.items():
        assert abs(got[c].mean() - mean) < 0.1, c
    assert got.i.min() == 1 and got.i.max() == 6 and set(got.d) == {0, 1, 2}
