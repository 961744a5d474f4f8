"""Queries over leaves, neighbours and patches stored by key range, and over domains with walls, beside their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import basis
from ..operators import dg, dg_leaves, halo, tree
from ..operators.layout import PatchLayout
from ..operators.store import Store
from ..sources import tables as S
from . import octree
from . import sql as Q

C2, C3 = S.CODEC, S.CODEC3
LAYOUT2, LAYOUT3 = PatchLayout((S.PATCH,) * 2, 1), PatchLayout((S.PATCH3,) * 3, 1)
#: Trees that a bucket holds, and zones of a store, at most; zones are no finer than the coarsest leaves.
TREES_OF_BUCKET, MOST_ZONES, FINEST_ZONE = 32, 32, 1


def new_store(spark, codec, trees: int) -> Store:
    """A store for some number of trees: buckets grow with it, and zones hold more trees instead of becoming more."""
    level = FINEST_ZONE
    while trees << max(codec.rank * level, 0) >> max(-codec.rank * level, 0) > MOST_ZONES:
        level -= 1
    return Store(spark, codec, level, max(4, -(-trees // TREES_OF_BUCKET)))


def advanced_store(spark, sf: str, passes: int = len(S.PASSES)) -> Store:
    """The quadtrees of the events after some passes, each applied to the stored tables."""
    at = S.points(spark, sf)
    total = S.totals(at)
    store = new_store(spark, C2, total.count())
    store.create(tree.uniform(spark, C2, S.START_LEVEL, total.select("g")))
    for share in S.PASSES[:passes]:
        leaves = store.leaves()
        flags = S.point_flags(leaves, at, share, total).checkpoint()
        store.advance(*tree.plan_regrid(leaves, flags, C2, S.MIN_LEVEL, store.links()))
    return store


def stored(spark, codec, leaves: DataFrame, patches: DataFrame) -> Store:
    store = new_store(spark, codec, leaves.select(codec.tree(F.col("patch_id"))).distinct().count())
    store.create(leaves)
    store.save("patches", patches.select("patch_id", "u"))
    return store


def reflecting(v: Column, field: str, axis: Column, normal: int) -> Column:
    """A wall: the field ``v`` is a velocity along x and turns round at faces across x, ``u`` stays."""
    value = F.get(v, F.lit(0))
    return F.when(axis == normal, -value).otherwise(value) if field == "v" else value


def _walled(leaves: DataFrame, patches: DataFrame, codec, layout: PatchLayout) -> DataFrame:
    patches = patches.withColumn("v", F.col("u"))
    links = tree.neighbors(leaves, codec, periodic=False)
    using = halo.HaloOperators(boundary=lambda v, f, a: reflecting(v, f, a, codec.rank - 1))
    return halo.patch_halos(links, patches, codec, layout, ["u", "v"], using)


_OPEN2 = "l.x * 16 + {0}.i * 2 * l.s BETWEEN 0 AND 2047 AND l.y * 16 + {0}.j * 2 * l.s BETWEEN 0 AND 2047"
_OPEN3 = " AND ".join(f"l.{a} + {{0}}.{m} * (l.s // 4) BETWEEN 0 AND 127" for a, m in zip("xyz", "ijk", strict=True))


def _mirror(m: str, n: int) -> str:
    return f"c.{m} = CASE WHEN w.{m} < 0 THEN -1 - w.{m} WHEN w.{m} >= {n} THEN {2 * n - 1} - w.{m} ELSE w.{m} END"


def _walls(leaf: str, names: tuple[str, ...], n: int, inside: str, normal: int) -> str:
    at = lambda alias: ", ".join(f"{alias}.{m}" for m in names)
    return f"""SELECT h.patch_id, h.dir, {at('h')}, h.relation, {Q.r('h.u')} AS u, {Q.r('h.u')} AS v FROM halo h JOIN {leaf} l ON l.patch_id = h.patch_id WHERE {inside.format('h')}
UNION ALL SELECT w.patch_id, w.dir, {at('w')}, 'boundary', {Q.r('c.u')}, {Q.r(f'CASE WHEN w.dir // 2 = {normal} THEN -c.u ELSE c.u END')}
  FROM want w JOIN {leaf} l ON l.patch_id = w.patch_id JOIN cells c ON c.patch_id = w.patch_id AND {' AND '.join(_mirror(m, n) for m in names)}
  WHERE NOT ({inside.format('w')})"""


#: Velocity of the advection on leaf sets.
VELOCITY = (1.0, 0.5)


def leaf_nodes(leaves: DataFrame, values: DataFrame) -> DataFrame:
    """patch_id, u: the value of its tree's grid at a leaf's centre, times 1 + 0.2 x + 0.1 y of each node of two by two."""
    side = C2.side(F.col("level"))
    at = {a: F.floor((F.col(a) * 2 + side) / 4).cast("long") for a in ("x", "y")}
    found = leaves.select("patch_id", C2.tree(F.col("patch_id")).alias("g"), *(c.alias(a) for a, c in at.items())).join(values, ["g", "x", "y"])
    points = basis.tensor_points(2, 2)
    return found.select("patch_id", F.array(*(F.col("u") * F.lit(float(1 + 0.2 * px + 0.1 * py)) for py, px in points)).alias("u"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"{x!r}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


def _dg_leaf_sql() -> str:
    """Upwind fluxes in long form: a row a node, with tables of weights from plain polynomials."""
    x = (np.polynomial.legendre.leggauss(2)[0] + 1) / 2
    phi = [np.poly1d([1 / (x[i] - x[1 - i]), -x[1 - i] / (x[i] - x[1 - i])]) for i in (0, 1)]
    node = [(2 * j + i, float(x[j]), float(x[i])) for j in (0, 1) for i in (0, 1)]
    face = [
        (2 * dim + up, (k // 2 if dim else k % 2), k, float(phi[k % 2 if dim else k // 2](up))) for dim in (0, 1) for up in (0, 1) for k in range(4)
    ]
    half = [(s, q, i, float(phi[i]((x[q] + s) / 2))) for s in (0, 1) for q in (0, 1) for i in (0, 1)]
    vol = [
        (2 * j + i, 2 * m + k, 0.25 * float(VELOCITY[0] * phi[i].deriv()(x[k]) * (m == j) + VELOCITY[1] * phi[j].deriv()(x[m]) * (k == i)))
        for j in (0, 1)
        for i in (0, 1)
        for m in (0, 1)
        for k in (0, 1)
    ]
    return f"""WITH RECURSIVE {Q.passes(3)}, {Q.nbr(3)}, {Q.GRID},
node(k, ny, nx) AS (VALUES {_values(node)}), face(dir, t, k, w) AS (VALUES {_values(face)}),
half(s, q, i, w) AS (VALUES {_values(half)}), vol(o, k, w) AS (VALUES {_values(vol)}),
q0 AS MATERIALIZED (SELECT l.patch_id, l.s / 128 AS edge, k, u * (1 + 0.2 * nx + 0.1 * ny) AS v
  FROM leaf3 l JOIN grid ON grid.g = l.g AND grid.x = (2 * l.x + l.s) // 4 AND grid.y = (2 * l.y + l.s) // 4, node),
trace AS MATERIALIZED (SELECT patch_id, dir, t, sum(w * v) AS v FROM q0 JOIN face USING (k) GROUP BY ALL),
mortar AS MATERIALIZED (SELECT n.patch_id, n.dir, n.relation, n.n_id,
    CASE WHEN n.dir < 2 THEN (f.x // f.s) % 2 ELSE (f.y // f.s) % 2 END AS s
  FROM nbr3 n JOIN leaf3 f ON f.patch_id = CASE WHEN n.relation = 'coarser' THEN n.patch_id ELSE n.n_id END),
inner_side AS MATERIALIZED (
  SELECT m.patch_id, m.dir, m.n_id, t.t AS q, t.v FROM mortar m JOIN trace t ON t.patch_id = m.patch_id AND t.dir = m.dir WHERE m.relation <> 'finer'
  UNION ALL SELECT m.patch_id, m.dir, m.n_id, h.q, sum(h.w * t.v) FROM mortar m JOIN trace t ON t.patch_id = m.patch_id AND t.dir = m.dir
    JOIN half h ON h.s = m.s AND h.i = t.t WHERE m.relation = 'finer' GROUP BY ALL),
outer_side AS MATERIALIZED (
  SELECT m.patch_id, m.dir, m.n_id, t.t AS q, t.v FROM mortar m JOIN trace t ON t.patch_id = m.n_id AND t.dir = xor(m.dir, 1) WHERE m.relation <> 'coarser'
  UNION ALL SELECT m.patch_id, m.dir, m.n_id, h.q, sum(h.w * t.v) FROM mortar m JOIN trace t ON t.patch_id = m.n_id AND t.dir = xor(m.dir, 1)
    JOIN half h ON h.s = m.s AND h.i = t.t WHERE m.relation = 'coarser' GROUP BY ALL),
flux AS MATERIALIZED (SELECT m.*, a.q, CASE WHEN m.dir < 2 THEN {VELOCITY[1]!r}::DOUBLE ELSE {VELOCITY[0]!r}::DOUBLE END * CASE WHEN m.dir % 2 = 1 THEN a.v ELSE -b.v END AS f
  FROM mortar m JOIN inner_side a USING (patch_id, dir, n_id) JOIN outer_side b ON b.patch_id = m.patch_id AND b.dir = m.dir AND b.n_id = m.n_id AND b.q = a.q),
lift AS MATERIALIZED (SELECT patch_id, dir, q AS t, 0.5 * f AS w FROM flux WHERE relation <> 'finer'
  UNION ALL SELECT patch_id, dir, h.i, 0.25 * h.w * f FROM flux JOIN half h ON h.s = flux.s AND h.q = flux.q WHERE relation = 'finer'),
faces AS MATERIALIZED (SELECT l.patch_id, k, sum(l.w * face.w) AS v FROM lift l JOIN face ON face.dir = l.dir AND face.t = l.t GROUP BY ALL),
volume AS MATERIALIZED (SELECT patch_id, edge, o AS k, sum(w * v) AS v FROM q0 JOIN vol USING (k) GROUP BY ALL)
SELECT patch_id, k::INTEGER AS k, {Q.r('(volume.v - faces.v) / (edge * 0.25)')} AS v FROM volume JOIN faces USING (patch_id, k)"""


def register(query, checkpoints) -> None:
    """Adds the queries by the decorator of ``plans.queries``."""

    def r6(c: str) -> Column:
        return F.round(c, 6) + F.lit(0.0)

    @query(f"WITH RECURSIVE {Q.passes(3)}, {Q.nbr(3)} SELECT patch_id, dir, relation, n_id FROM nbr3")
    def stored_neighbors(spark, sf):
        """The neighbour table kept up to date over three passes by what each changes."""
        checkpoints(spark)
        return advanced_store(spark, sf).links()

    @query(f"WITH RECURSIVE {Q.passes(3)} SELECT patch_id, level, x, y FROM leaf3")
    def stored_leaves(spark, sf):
        """The leaf set after three passes that rewrite only the zones with changes."""
        checkpoints(spark)
        return advanced_store(spark, sf).leaves()

    @query(f"WITH RECURSIVE {Q.HALO} SELECT patch_id, dir, j, i, relation, {Q.r('u')} AS u FROM halo")
    def stored_halo(spark, sf):
        """Halos from tables bucketed by the neighbour's key."""
        checkpoints(spark)
        leaves = S.leaf_set(spark, sf)
        store = stored(spark, C2, leaves, S.leaf_patches(spark, sf, leaves))
        found = halo.patch_halos(store.links(), store.read("patches"), C2, LAYOUT2, ["u"])
        return found.select("patch_id", "dir", "j", "i", "relation", r6("u").alias("u"))

    @query(octree.HALO_SQL)
    def octree_halo(spark, sf):
        checkpoints(spark)
        leaves = S.octree(spark, sf)[0]
        store = stored(spark, C3, leaves, S.octree_patches(spark, sf, leaves))
        found = halo.patch_halos(store.links(), store.read("patches"), C3, LAYOUT3, ["u"])
        return found.select("patch_id", "dir", *tree.INDICES, "relation", r6("u").alias("u"))

    @query(
        f"WITH {Q.STATE} SELECT g, x, y, {Q.r('e')} AS e, {Q.r('p')} AS p, {Q.r('mx * mx / rho + p')} AS xmx, {Q.r('my * mx / rho')} AS xmy, {Q.r('mx')} AS xrho, "
        f"{Q.r('(e + p) * mx / rho')} AS xe, {Q.r('my * my / rho + p')} AS ymy, {Q.r('(e + p) * my / rho')} AS ye, "
        f"{Q.r('abs(mx / rho) + a')} AS sx, {Q.r('abs(my / rho) + a')} AS sy FROM state"
    )
    def dg_euler_terms(spark, sf):
        """Energy, pressure, fluxes and wave speeds of the nodal Euler equations at the gas states."""
        gas, euler = S.primitive_grid(spark, sf), dg.NodalEuler()
        momenta = [F.col("rho") * F.col(v) for v in ("vx", "vy")]
        rows = gas.select("g", "x", "y", momenta[0].alias("mx"), momenta[1].alias("my"), "rho", euler.energy(momenta, F.col("rho"), F.col("p")).alias("e"))
        node = {c: F.array(F.col(c)) for c in euler.components}
        terms = {"p": euler.pressure(node)}
        for axis, name in enumerate("xy"):
            terms |= {f"{name}{c}": f for c, f in euler.flux(node, axis).items()}
        wanted = ["p", "xmx", "xmy", "xrho", "xe", "ymy", "ye"]
        found = rows.select(
            "g", "x", "y", "e", *(F.get(terms[c], F.lit(0)).alias(c) for c in wanted), euler.speed(node, 0).alias("sx"), euler.speed(node, 1).alias("sy")
        )
        return found.select("g", "x", "y", *(r6(c).alias(c) for c in ("e", *wanted, "sx", "sy")))

    @query(_dg_leaf_sql())
    def dg_leaf_rhs(spark, sf):
        """Advection on the leaves of the quadtrees, faces between levels by mortars."""
        checkpoints(spark)
        leaves = S.leaf_set(spark, sf)
        cells = leaf_nodes(leaves, S.grid(spark, sf)).checkpoint()
        found = dg_leaves.leaf_rhs(cells, tree.neighbors(leaves, C2), C2, 2, dg.LinearAdvection(VELOCITY), ["u"])
        return found.select("patch_id", F.posexplode("u").alias("k", "v")).select("patch_id", "k", r6("v").alias("v"))

    @query(f"WITH RECURSIVE {Q.HALO} {_walls('leaf3', ('j', 'i'), 8, _OPEN2, 1)}")
    def halo_walls(spark, sf):
        """A domain with reflecting walls in two dimensions."""
        checkpoints(spark)
        leaves = S.leaf_set(spark, sf)
        found = _walled(leaves, S.leaf_patches(spark, sf, leaves), C2, LAYOUT2)
        return found.select("patch_id", "dir", "j", "i", "relation", r6("u").alias("u"), r6("v").alias("v"))

    @query(f"{octree.HALO_CTES} {_walls('leaf2', ('k', 'j', 'i'), 4, _OPEN3, 2)}")
    def octree_halo_walls(spark, sf):
        """A domain with reflecting walls in three dimensions."""
        checkpoints(spark)
        leaves = S.octree(spark, sf)[0]
        found = _walled(leaves, S.octree_patches(spark, sf, leaves), C3, LAYOUT3)
        return found.select("patch_id", "dir", *tree.INDICES, "relation", r6("u").alias("u"), r6("v").alias("v"))
