"""Queries over own operators on patches' arrays, and over measures taken while writing, beside their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.physics import Euler
from ..operators import fvm, halo, measures, patch_arrays, tree
from ..operators.layout import PatchLayout
from ..sources import tables as S
from . import sql as Q

C2 = S.CODEC
LAYOUT = PatchLayout((S.PATCH,) * 2, 1)
#: Jumps from which a patch is refined, and below which it may be coarsened.
STEEP, FLAT = 240.0, 200.0


def _minmod(a: str, b: str) -> str:
    return f"CASE WHEN {a} * {b} > 0 THEN CASE WHEN abs({a}) < abs({b}) THEN {a} ELSE {b} END ELSE 0 END"


_BESIDE = f"""{Q.PATCHES},
beside AS MATERIALIZED (SELECT *, u - coalesce(lag(u) OVER l, u) AS il, coalesce(lead(u) OVER l, u) - u AS ir, u - coalesce(lag(u) OVER c, u) AS jl, coalesce(lead(u) OVER c, u) - u AS jr
  FROM cells WINDOW l AS (PARTITION BY patch_id, j ORDER BY i), c AS (PARTITION BY patch_id, i ORDER BY j))"""


def steep(values: np.ndarray) -> np.ndarray:
    jump = patch_arrays.largest_jump(values)
    return np.where(jump > STEEP, tree.REFINE, np.where(jump < FLAT, tree.COARSEN, tree.STABLE))


def register(query, checkpoints) -> None:
    """Adds the queries by the decorator of ``plans.queries``."""

    def cells(patches):
        at = patches.select("patch_id", F.posexplode("u").alias("n", "u"))
        return at.select("patch_id", F.floor(F.col("n") / S.PATCH).cast("int").alias("j"), (F.col("n") % S.PATCH).alias("i"), (F.round("u", 6) + F.lit(0.0)).alias("u"))

    @query(
        f"""WITH {_BESIDE} SELECT {Q.enc(['(x // 4) * 8', '(y // 4) * 8'], '4', 'g')} AS patch_id, (2 * (y % 4) + a)::INTEGER AS j, (2 * (x % 4) + b)::INTEGER AS i,
  {Q.r(f"u + (a - 0.5) / 2 * {_minmod('jl', 'jr')} + (b - 0.5) / 2 * {_minmod('il', 'ir')}")} AS u FROM beside, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(a, b)"""
    )
    def prolong_limited(spark, sf):
        """Limited slopes, which see the cells beside, by a table function."""
        patches = halo.patch_rows(S.patches(spark, sf), LAYOUT, ["u"])
        return cells(patch_arrays.prolong_patches(patches, C2, LAYOUT, ["u"]))

    @query(
        f"WITH {Q.PATCHES} SELECT {Q.enc(['(x // 16) * 32', '(y // 16) * 32'], '2', 'g')} AS patch_id, ((y % 16) // 2)::INTEGER AS j, ((x % 16) // 2)::INTEGER AS i, {Q.r('avg(u)')} AS u FROM cells GROUP BY ALL"
    )
    def restrict_arrays(spark, sf):
        """Means of whole families by an aggregate function."""
        patches = halo.patch_rows(S.patches(spark, sf), LAYOUT, ["u"])
        return cells(patch_arrays.restrict_patches(patches, C2, LAYOUT, ["u"]))

    @query(
        f"""WITH {_BESIDE} SELECT patch_id, CASE WHEN jump > {STEEP} THEN 'refine' WHEN jump < {FLAT} THEN 'coarsen' ELSE 'stable' END AS status
  FROM (SELECT patch_id, max(greatest(abs(ir), abs(jr))) AS jump FROM beside GROUP BY patch_id)"""
    )
    def refine_by_jump(spark, sf):
        """Flags by the steepest jump between cells of a patch, from a function of its array."""
        patches = halo.patch_rows(S.patches(spark, sf), LAYOUT, ["u"])
        return patch_arrays.flags_of_arrays(patches, LAYOUT, "u", steep)

    @query(
        f"""WITH {Q.STATE} SELECT count(*) AS n, {Q.r('0.3 * min(least(1.0 / 64 / (abs(mx / rho) + a), 1.0 / 64 / (abs(my / rho) + a)))')} AS dt,
  count(*) FILTER (WHERE rho > 1.1) + count(*) FILTER (WHERE e > 1.1) + count(*) FILTER (WHERE abs(mx) > 1.1) + count(*) FILTER (WHERE abs(my) > 1.1) AS n_large FROM state"""
    )
    def measured_state(spark, sf):
        """Cells, time-step limit and large values of the gas states, taken by the tasks that write them."""
        checkpoints(spark)
        gas = Euler(2)
        state = S.primitive_grid(spark, sf)
        state = state.select("g", "x", "y", *(c.alias(k) for k, c in gas.conservative({c: F.col(c) for c in ("rho", "vx", "vy", "p")}).items()))
        h = F.lit(1 / S.EXTENT)
        wanted = {"n": F.count(F.lit(1)), "dt": fvm.cfl_measure(gas, [h, h], 0.3), **measures.unsound(gas.fields, 1.1)}
        found = measures.written(state, wanted)[1]
        row = spark.createDataFrame([(found["n"], found["dt"], found["n_large"])], "n long, dt double, n_large long")
        return row.withColumn("dt", F.round("dt", 6) + F.lit(0.0))
