"""The grid engine's queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import basis, geometry, numeric, physics
from ..functions import tensors as T
from ..operators import dg, fvm, halo, intergrid, tree
from ..operators.layout import PatchLayout
from ..sources import tables as S
from . import arrays, lookups, loops, meshes, octree, stored
from . import sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

C2, C3 = S.CODEC, S.CODEC3
LAYOUT = PatchLayout((S.PATCH, S.PATCH), 1)
UNIT = geometry.Geometry((1.0, 1.0), (S.PATCH, S.PATCH), C2.depth)
DT = 0.00390625
#: The column that tells grids apart.
BY = ("g",)


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def r9(c: Column | str) -> Column:
    """For values whose decimals would end in a tie at six or nine."""
    return r6(c, 12)


def checkpoints(spark: SparkSession) -> None:
    """Loops cut their lineage in the folder of spark.checkpoint.dir."""
    S.shared_dir(spark)


# --- keys -------------------------------------------------------------------------------------


def _key(k: DataFrame) -> Column:
    return C2.encode([F.col("x"), F.col("y")], F.col("n"))


@query(f"WITH {Q.KEYS} SELECT o, n, {Q.enc(['x', 'y'], 'n')} AS key FROM keys")
def morton_encode_2d(spark, sf):
    k = S.keys(spark, sf)
    return k.select("o", "n", _key(k).alias("key"))


@query(f"WITH {Q.KEYS} SELECT o, n, {Q.enc(['x', 'y', 'z'], 'n')} AS key FROM keys")
def morton_encode_3d(spark, sf):
    return S.keys(spark, sf).select("o", "n", C3.encode([F.col("x"), F.col("y"), F.col("z")], F.col("n")).alias("key"))


@query(f"WITH {Q.KEYS} SELECT o, n, x, y, n AS level FROM keys")
def morton_decode_2d(spark, sf):
    k = S.keys(spark, sf)
    x, y = C2.coords(F.col("key"))
    return k.select("o", "n", _key(k).alias("key")).select("o", "n", x.alias("x"), y.alias("y"), C2.level(F.col("key")).alias("level"))


@query(f"WITH {Q.KEYS} SELECT o, n, x, y, z FROM keys")
def morton_decode_3d(spark, sf):
    x, y, z = C3.coords(F.col("key"))
    return morton_encode_3d(spark, sf).select("o", "n", x.alias("x"), y.alias("y"), z.alias("z"))


@query(f"WITH {Q.KEYS} SELECT o, n, {Q.enc(['x - x % (2 * s)', 'y - y % (2 * s)'], 'n - 1')} AS parent FROM keys")
def morton_parent(spark, sf):
    return morton_encode_2d(spark, sf).select("o", "n", C2.parent(F.col("key")).alias("parent"))


@query(
    f"WITH {Q.KEYS} SELECT o, n, k, {Q.enc(['x + (k & 1) * (s // 2)', 'y + (k >> 1) * (s // 2)'], 'n + 1')} AS child "
    "FROM keys, (SELECT range::INTEGER AS k FROM range(4)) WHERE n < 7"
)
def morton_children(spark, sf):
    return morton_encode_2d(spark, sf).filter("n < 7").select("o", "n", F.posexplode(C2.children(F.col("key"))).alias("k", "child"))


@query(
    f"WITH {Q.KEYS} SELECT o, n, ((x // s) % 2 + 2 * ((y // s) % 2))::INTEGER AS off, "
    f"{Q.enc(['x - x % (2 * s) + s', 'y - y % (2 * s) + s'], 'n')} AS last FROM keys"
)
def morton_sibling_offset(spark, sf):
    k = morton_encode_2d(spark, sf)
    return k.select("o", "n", C2.offset_of(F.col("key")).alias("off"), C2.sibling(F.col("key"), 3).alias("last"))


@query(
    f"""WITH {Q.KEYS} SELECT o, n, dir, CASE WHEN x + dx * s BETWEEN 0 AND 127 AND y + dy * s BETWEEN 0 AND 127 THEN {Q.enc(['x + dx * s', 'y + dy * s'], 'n')} END AS open,
 {Q.enc(['(x + dx * s + 128) % 128', '(y + dy * s + 128) % 128'], 'n')} AS wrapped
FROM keys, (VALUES (0, 0, -1), (1, 0, 1), (2, -1, 0), (3, 1, 0)) d(dir, dx, dy)"""
)
def morton_neighbors(spark, sf):
    faces = F.array(
        *(
            F.struct(
                F.lit(d).alias("dir"),
                C2.neighbor(F.col("key"), (dx, dy)).alias("open"),
                C2.neighbor(F.col("key"), (dx, dy), periodic=True).alias("wrapped"),
            )
            for d, dx, dy in tree.DIRECTIONS
        )
    )
    return morton_encode_2d(spark, sf).select("o", "n", F.explode(faces).alias("f")).select("o", "n", "f.*")


@query(f"WITH {Q.KEYS} SELECT o, n, lpad(bin({Q.enc(['x', 'y'], 'n')}), 64, '0') AS bits FROM keys")
def morton_bits(spark, sf):
    return morton_encode_2d(spark, sf).select("o", "n", C2.bits(F.col("key")).alias("bits"))


@query(
    f"""WITH {Q.KEYS} SELECT o, n, list_aggregate(list_transform(range(1, n + 1), lambda i: ((x >> (7 - i)) & 1) + 2 * ((y >> (7 - i)) & 1) + 1), 'string_agg', '') AS path FROM keys"""
)
def hierarchical_key(spark, sf):
    return morton_encode_2d(spark, sf).select("o", "n", C2.hierarchical(F.col("key")).alias("path"))


@query("SELECT l_orderkey AS o, l_linenumber::INTEGER AS n, l_partkey % (1::BIGINT << (7 - l_linenumber)) = 0 AND l_suppkey % (1::BIGINT << (7 - l_linenumber)) = 0 AND l_partkey < 128 AND l_suppkey < 128 AS valid FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7")
def morton_valid_coord(spark, sf):
    line = S.read(spark, sf, "lineitem").filter("l_linenumber between 1 and 7")
    level = F.col("l_linenumber")
    return line.select(F.col("l_orderkey").alias("o"), level.cast("int").alias("n"), C2.is_valid([F.col("l_partkey"), F.col("l_suppkey")], level).alias("valid"))


@query(f"WITH {Q.KEYS} SELECT key, row_number() OVER (ORDER BY key) AS place FROM (SELECT DISTINCT {Q.enc(['x', 'y'], 'n')} AS key FROM keys)")
def zorder_sort_rank(spark, sf):
    checkpoints(spark)
    distinct = morton_encode_2d(spark, sf).select(F.col("key").alias("patch_id")).distinct()
    return loops.row_numbers(distinct).select(F.col("patch_id").alias("key"), "place")


# --- geometry and layout ------------------------------------------------------------------------


@query(
    f"""WITH {Q.KEYS} SELECT o, n, {Q.r('10.0 / pow(2, n)')} AS px, {Q.r('20.0 / pow(2, n) / 8')} AS hy, {Q.r('10.0 * x / 128')} AS x0, {Q.r('20.0 * y / 128')} AS y0,
 {Q.r('10.0 * x / 128 + 3.5 * 10.0 / pow(2, n) / 8')} AS cx, {Q.r('20.0 * y / 128 + 5 * 20.0 / pow(2, n) / 8')} AS ly, {Q.r('200.0 / pow(4, n) / 64')} AS vol, {Q.r('20.0 / pow(2, n) / 8')} AS ax FROM keys"""
)
def cell_geometry(spark, sf):
    g, n = geometry.Geometry((10.0, 20.0), (8, 8), 7), F.col("n")
    return S.keys(spark, sf).select(
        "o",
        "n",
        r6(g.patch_size(n, 0)).alias("px"),
        r6(g.cell_size(n, 1)).alias("hy"),
        r6(g.patch_coord(F.col("x"), 0)).alias("x0"),
        r6(g.patch_coord(F.col("y"), 1)).alias("y0"),
        r6(g.cell_center(F.col("x"), n, F.lit(3), 0)).alias("cx"),
        r6(g.cell_coord(F.col("y"), n, F.lit(5), 1)).alias("ly"),
        r6(g.volume(n)).alias("vol"),
        r6(g.area(n, 0)).alias("ax"),
    )


@query(
    f"SELECT l_orderkey AS o, l_linenumber::INTEGER AS n, {Q.r('1.0 / pow(2, l_linenumber) / 4', 12)} AS edge, {Q.r('l_tax + l_discount * (1.0 / pow(2, l_linenumber) / 4)', 12)} AS glob, {Q.r('l_discount', 12)} AS ref FROM lineitem"
)
def reference_mapping(spark, sf):
    e = geometry.edge(F.col("l_linenumber"), 4)
    there = geometry.reference_to_global(F.col("l_tax"), F.col("l_discount"), e)
    return S.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o"),
        F.col("l_linenumber").cast("int").alias("n"),
        r9(e).alias("edge"),
        r9(there).alias("glob"),
        r9(geometry.global_to_reference(F.col("l_tax"), there, e)).alias("ref"),
    )


@query("SELECT l_orderkey AS o, l_linenumber::INTEGER AS n, ((l_partkey % 100) // 20)::INTEGER AS a, ((l_partkey % 20) // 4)::INTEGER AS b, (l_partkey % 4)::INTEGER AS c, (l_partkey % 100)::BIGINT AS lin, ((l_partkey % 20) // 4 - 1)::INTEGER AS inner_b FROM lineitem")
def index_arithmetic(spark, sf):
    lin = F.col("l_partkey") % 100
    a, b, c = geometry.multi_index(lin, (5, 5, 4))
    return S.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o"),
        F.col("l_linenumber").cast("int").alias("n"),
        a.alias("a"),
        b.alias("b"),
        c.alias("c"),
        geometry.linear_index([a, b, c], (5, 5, 4)).cast("long").alias("lin"),
        geometry.remove_halo([b], 1)[0].alias("inner_b"),
    )


@query(
    f"""WITH {Q.PATCHES} SELECT patch_id, (i < 1 OR i > 6 OR j < 1 OR j > 6) AS is_halo, j > 6 AND i BETWEEN 1 AND 6 AS upper_y, i < 1 AND j BETWEEN 1 AND 6 AS lower_x, count(*) AS n, sum(u) AS u FROM cells GROUP BY ALL"""
)
def halo_mask(spark, sf):
    inner = PatchLayout((6, 6), 1)
    at = [F.col("j"), F.col("i")]
    return (
        S.patches(spark, sf)
        .groupBy("patch_id", inner.is_halo(at).alias("is_halo"), inner.in_face_halo(at, 0, True).alias("upper_y"), inner.in_face_halo(at, 1, False).alias("lower_x"))
        .agg(F.count("*").alias("n"), F.sum("u").alias("u"))
    )


@query(f"WITH {Q.PATCHES} SELECT patch_id, j, i, u FROM cells WHERE j BETWEEN 2 AND 5 AND i BETWEEN 2 AND 5")
def interior_slice(spark, sf):
    at = [F.col("j"), F.col("i")]
    return S.patches(spark, sf).filter(PatchLayout((4, 4), 2).in_interior(at)).select("patch_id", "j", "i", "u")


# --- between levels -----------------------------------------------------------------------------


@query(f"WITH {Q.PATCHES} SELECT {Q.enc(['(x // 16) * 32', '(y // 16) * 32'], '2', 'g')} AS patch_id, ((y % 16) // 2)::INTEGER AS j, ((x % 16) // 2)::INTEGER AS i, {Q.r('avg(u)')} AS u FROM cells GROUP BY ALL")
def restrict_mean(spark, sf):
    return intergrid.restrict(S.patches(spark, sf), C2, 8, ["u"]).select("patch_id", "j", "i", r6("u").alias("u"))


_FINE = f"fine AS (SELECT {Q.enc(['(x // 4) * 8', '(y // 4) * 8'], '4', 'g')} AS patch_id, (2 * (y % 4) + a)::INTEGER AS j, (2 * (x % 4) + b)::INTEGER AS i, u FROM cells, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(a, b))"


@query(f"WITH {Q.PATCHES}, {_FINE} SELECT * FROM fine")
def prolong_copy(spark, sf):
    return intergrid.prolong(S.patches(spark, sf), C2, 8, ["u"]).select("patch_id", "j", "i", "u")


@query(f"WITH {Q.PATCHES} SELECT patch_id, j, i, {Q.r('u')} AS u FROM cells")
def restrict_prolong_roundtrip(spark, sf):
    fine = intergrid.prolong(S.patches(spark, sf), C2, 8, ["u"])
    return intergrid.restrict(fine, C2, 8, ["u"]).select("patch_id", "j", "i", r6("u").alias("u"))


_FLAGS = "SELECT patch_id, max(u) AS peak, CASE WHEN max(u) > avg_u * 1.9 THEN 'refine' WHEN max(u) < avg_u * 1.6 THEN 'coarsen' ELSE 'stable' END AS status FROM cells, (SELECT avg(u) AS avg_u FROM cells) GROUP BY patch_id, avg_u"


def _flags(spark, sf):
    cells = S.patches(spark, sf)
    mean = cells.agg(F.avg("u").alias("mean"))  # one row
    return intergrid.threshold_flags(cells.join(F.broadcast(mean)), F.col("u"), F.col("mean") * 1.9, F.col("mean") * 1.6, 1, 6)


@query(f"WITH {Q.PATCHES} {_FLAGS}")
def refine_flags(spark, sf):
    return _flags(spark, sf).select("patch_id", "peak", "status")


@query(f"WITH {Q.PATCHES} SELECT status, count(*) AS n FROM ({_FLAGS}) GROUP BY status")
def refine_flag_counts(spark, sf):
    return intergrid.count_flags(_flags(spark, sf))


# --- leaf sets ----------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {Q.passes(3)} SELECT patch_id, level, x, y FROM leaf3")
def reconstruct_leaves(spark, sf):
    checkpoints(spark)
    return S.leaf_set(spark, sf).select("patch_id", "level", "x", "y")


@query(f"WITH RECURSIVE {Q.passes(3)}, {Q.nbr(3)} SELECT patch_id, dir, relation, n_id FROM nbr3")
def neighbor_relation(spark, sf):
    checkpoints(spark)
    return tree.neighbors(S.leaf_set(spark, sf), C2)


_PASS0 = ",\n".join([Q.passes(0), *Q.step(0, S.PASSES[0])])
_PASS2 = ",\n".join([Q.passes(2), *Q.step(2, S.PASSES[2])])


@query(f"WITH RECURSIVE {_PASS0} SELECT {Q.enc(['x', 'y'], 'level', 'g')} AS patch_id FROM fam0")
def coarsen_families(spark, sf):
    checkpoints(spark)
    _, flags = S.flags_of_pass(spark, sf, 0)
    return tree.coarsen_families(flags, C2, S.MIN_LEVEL)


@query(f"WITH RECURSIVE {_PASS2} SELECT patch_id FROM r2")
def balance_closure(spark, sf):
    checkpoints(spark)
    leaves, flags = S.flags_of_pass(spark, sf, 2)
    return tree.balance_refinement(tree.eligible(flags, C2), leaves, C2)


@query(f"WITH RECURSIVE {_PASS0} SELECT {Q.enc(['x', 'y'], 'level', 'g')} AS patch_id FROM ok0")
def coarsen_prune(spark, sf):
    checkpoints(spark)
    leaves, flags = S.flags_of_pass(spark, sf, 0)
    return tree.plan_regrid(leaves, flags, C2, S.MIN_LEVEL)[1]


@query(f"WITH RECURSIVE {Q.passes(3)} SELECT 'born' AS change, patch_id FROM leaf3 WHERE patch_id NOT IN (SELECT patch_id FROM leaf2) UNION ALL SELECT 'gone', patch_id FROM leaf2 WHERE patch_id NOT IN (SELECT patch_id FROM leaf3)")
def topology_change(spark, sf):
    checkpoints(spark)
    old, new = (S.leaf_set(spark, sf, k).select("patch_id") for k in (2, 3))
    return new.exceptAll(old).select(F.lit("born").alias("change"), "patch_id").unionByName(old.exceptAll(new).select(F.lit("gone").alias("change"), "patch_id"))


@query(f"WITH RECURSIVE {Q.passes(3)} SELECT patch_id, count(p.x) AS n FROM leaf3 l JOIN points p ON p.g = l.g AND p.x >= l.x AND p.x < l.x + l.s AND p.y >= l.y AND p.y < l.y + l.s GROUP BY patch_id")
def points_per_leaf(spark, sf):
    checkpoints(spark)
    return S.locate(S.points(spark, sf), S.leaf_set(spark, sf)).groupBy("patch_id").agg(F.sum("n").alias("n"))


@query(
    f"""WITH RECURSIVE {Q.passes(1)}, {Q.GRID},
places AS MATERIALIZED (SELECT l.patch_id, l.g, l.x * 16 + i * 2 * l.s AS cx, l.y * 16 + j * 2 * l.s AS cy, 2 * l.s AS w, (l.x * 16 + (2 * c.i + 1) * l.s) // 32 AS x, (l.y * 16 + (2 * c.j + 1) * l.s) // 32 AS y
  FROM leaf0 l CROSS JOIN (SELECT a.range AS j, b.range AS i FROM range(8) a, range(8) b) c),
old AS MATERIALIZED (SELECT patch_id, g, cx, cy, w, u FROM places JOIN grid USING (g, x, y)),
new AS MATERIALIZED (SELECT l.patch_id, l.g, j::INTEGER AS j, i::INTEGER AS i, l.x * 16 + i * 2 * l.s AS cx, l.y * 16 + j * 2 * l.s AS cy, 2 * l.s AS w FROM leaf1 l
  CROSS JOIN (SELECT a.range AS j, b.range AS i FROM range(8) a, range(8) b) c)
SELECT patch_id, j, i, {Q.r('avg(u)')} AS u FROM (
  SELECT n.patch_id, n.j, n.i, o.u FROM new n JOIN old o ON o.g = n.g AND o.w = n.w AND o.cx = n.cx AND o.cy = n.cy
  UNION ALL SELECT n.patch_id, n.j, n.i, o.u FROM new n JOIN old o ON o.g = n.g AND o.w = 2 * n.w AND o.cx = n.cx - n.cx % (2 * n.w) AND o.cy = n.cy - n.cy % (2 * n.w)
  UNION ALL SELECT n.patch_id, n.j, n.i, o.u FROM new n JOIN old o ON o.g = n.g AND 2 * o.w = n.w AND o.cx - o.cx % (2 * o.w) = n.cx AND o.cy - o.cy % (2 * o.w) = n.cy) GROUP BY ALL"""
)
def regrid_cells(spark, sf):
    checkpoints(spark)
    leaves, flags = S.flags_of_pass(spark, sf, 0)
    refined, families = tree.plan_regrid(leaves, flags, C2, S.MIN_LEVEL)
    patches = S.leaf_patches(spark, sf, leaves)
    return intergrid.regrid_patches(patches, refined, families, C2, S.PATCH, ["u"]).select("patch_id", "j", "i", r6("u").alias("u"))


# --- halos --------------------------------------------------------------------------------------


def _halo(spark, sf, relation):
    checkpoints(spark)
    leaves = S.leaf_set(spark, sf)
    nbr = tree.neighbors(leaves, C2).filter(F.col("relation") == relation)
    found = halo.patch_halos(nbr, S.leaf_patches(spark, sf, leaves), C2, LAYOUT, ["u"])
    return found.select("patch_id", "dir", "j", "i", r6("u").alias("u"))


def _halo_sql(relation: str) -> str:
    return f"WITH RECURSIVE {Q.HALO} SELECT patch_id, dir, j, i, {Q.r('u')} AS u FROM halo WHERE relation = '{relation}'"


@query(_halo_sql("same"))
def halo_same(spark, sf):
    return _halo(spark, sf, "same")


@query(_halo_sql("finer"))
def halo_finer(spark, sf):
    return _halo(spark, sf, "finer")


@query(_halo_sql("coarser"))
def halo_coarser(spark, sf):
    return _halo(spark, sf, "coarser")


# --- finite volumes -----------------------------------------------------------------------------

ADVECTION, EULER = physics.Advection((1.0, 0.5)), physics.Euler(2)


def _gas(spark, sf) -> DataFrame:
    prim = S.primitive_grid(spark, sf)
    cons = EULER.conservative({c: F.col(c) for c in ("rho", "vx", "vy", "p")})
    return prim.select("g", "x", "y", *(c.alias(k) for k, c in cons.items()))


@query(f"WITH {Q.GAS} SELECT g, x, y, {Q.r('rho')} AS rho, {Q.r('mx')} AS mx, {Q.r('my')} AS my, {Q.r('e')} AS e FROM gas")
def euler_prim_to_cons(spark, sf):
    return _gas(spark, sf).select("g", "x", "y", *(r6(c).alias(c) for c in EULER.fields))


@query(f"WITH RECURSIVE {Q.LEAF_CELLS} SELECT g, {Q.r('0.3 * min(least(s / 1024.0, s / 1024.0 / 0.5))', 9)} AS dt FROM cells GROUP BY g")
def cfl_dt_advection(spark, sf):
    """Of each tree, from the sizes of its own cells."""
    checkpoints(spark)
    cells = S.cells_of(S.leaf_patches(spark, sf, S.leaf_set(spark, sf)), C2, S.PATCH).withColumn("g", C2.tree(F.col("patch_id")))
    h = [UNIT.cell_size(F.col("level"), a) for a in (0, 1)]
    return fvm.cfl_limit(cells, ADVECTION, h, 0.3, BY).select("g", r6("dt", 9).alias("dt"))


@query(f"WITH {Q.STATE} SELECT g, {Q.r('0.3 * min(least(1.0 / 64 / (abs(mx / rho) + a), 1.0 / 64 / (abs(my / rho) + a)))')} AS dt FROM state GROUP BY g")
def cfl_dt_euler(spark, sf):
    h = F.lit(1 / 64)
    return fvm.cfl_limit(_gas(spark, sf), EULER, [h, h], 0.3, BY).select("g", r6("dt").alias("dt"))


_FLUX = ", ".join(f"{Q.r(Q.euler_flux('s', 't', a, f))} AS {f}_{a}" for a in (0, 1) for f in ("rho", "mx", "my", "e"))


@query(f"WITH {Q.STATE} SELECT s.g, s.x, s.y, {_FLUX} FROM state s JOIN state t ON t.g = s.g AND t.x = (s.x + 1) % 64 AND t.y = s.y")
def euler_rusanov_flux(spark, sf):
    gas = _gas(spark, sf)
    right = gas.select("g", ((F.col("x") + 63) % 64).alias("x"), "y", F.struct(*EULER.fields).alias("t"))
    own, other = {f: F.col(f) for f in EULER.fields}, {f: F.col(f"t.{f}") for f in EULER.fields}
    out = [r6(EULER.flux(own, other, a)[f]).alias(f"{f}_{a}") for a in (0, 1) for f in EULER.fields]
    return gas.join(right, ["g", "x", "y"]).select("g", "x", "y", *out)


_EULER_STEP = ", ".join(
    Q.r(
        f"s.{f} - {DT} * 64 * ({Q.euler_flux('s', 'rr', 0, f)} - {Q.euler_flux('ll', 's', 0, f)} + {Q.euler_flux('s', 'uu', 1, f)} - {Q.euler_flux('dd', 's', 1, f)})"
    )
    + f" AS {f}"
    for f in ("rho", "mx", "my", "e")
)


@query(
    f"""WITH {Q.STATE} SELECT s.g, s.x, s.y, {_EULER_STEP} FROM state s JOIN state rr ON rr.g = s.g AND rr.x = (s.x + 1) % 64 AND rr.y = s.y JOIN state ll ON ll.g = s.g AND ll.x = (s.x + 63) % 64 AND ll.y = s.y
 JOIN state uu ON uu.g = s.g AND uu.y = (s.y + 1) % 64 AND uu.x = s.x JOIN state dd ON dd.g = s.g AND dd.y = (s.y + 63) % 64 AND dd.x = s.x"""
)
def euler_step(spark, sf):
    out = fvm.uniform_step(_gas(spark, sf), EULER, DT, (1 / 64, 1 / 64), 64, BY)
    return out.select("g", "x", "y", *(r6(c).alias(c) for c in EULER.fields))


@query(f"WITH {Q.advect(1)} SELECT g, x, y, {Q.r('u')} AS u FROM s1")
def fvm_advection_step(spark, sf):
    return fvm.uniform_step(S.grid(spark, sf), ADVECTION, DT, (1 / 64, 1 / 64), 64, BY).select("g", "x", "y", r6("u").alias("u"))


@query(f"WITH {Q.advect(5)} SELECT g, x, y, {Q.r('u')} AS u FROM s5")
def fvm_advection_5_steps(spark, sf):
    checkpoints(spark)
    end = loops.run_uniform(S.grid(spark, sf), ADVECTION, (1 / 64, 1 / 64), 64, t_end=5 * DT, dt=DT, by=BY)
    return end.select("g", "x", "y", r6("u").alias("u"))


@query(f"WITH {Q.advect(3)} SELECT g, arg_max(x, (u, -x, -y)) AS x, arg_max(y, (u, -x, -y)) AS y, {Q.r('max(u)')} AS u FROM s3 GROUP BY g")
def pulse_argmax(spark, sf):
    checkpoints(spark)
    end = loops.run_uniform(S.grid(spark, sf), ADVECTION, (1 / 64, 1 / 64), 64, t_end=3 * DT, dt=DT, by=BY)
    return fvm.peak_cell(end, "u", ["x", "y"], BY).select("g", "x", "y", r6("u").alias("u"))


@query(
    f"""WITH RECURSIVE {Q.HALO}, pad AS MATERIALIZED (SELECT patch_id, level, j, i, u FROM cells UNION ALL SELECT patch_id, level, j, i, u FROM halo)
SELECT c.patch_id, c.j, c.i, {Q.r('c.u - 0.0005 * 8 * pow(2, c.level) * ((c.u - l.u) + 0.5 * (c.u - d.u))')} AS u FROM cells c
JOIN pad l ON l.patch_id = c.patch_id AND l.j = c.j AND l.i = c.i - 1 JOIN pad d ON d.patch_id = c.patch_id AND d.i = c.i AND d.j = c.j - 1"""
)
def fvm_refined_step(spark, sf):
    checkpoints(spark)
    leaves = S.leaf_set(spark, sf)
    out = fvm.refined_patch_step(S.leaf_patches(spark, sf, leaves), leaves, ADVECTION, 0.0005, UNIT, C2, LAYOUT)
    return out.select("patch_id", "j", "i", r6("u").alias("u"))


# --- tensors ------------------------------------------------------------------------------------

_VEC = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _vectors(spark, sf) -> DataFrame:
    return S.read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@query(
    f"""WITH {_VEC} SELECT vec_id, {Q.r('list_sum(list_transform(v, lambda x: x * 2 + 1))')} AS added, {Q.r('list_sum(list_transform(v, lambda x: greatest(x, 0.1)))')} AS top,
 {Q.r('list_sum(list_transform(v, lambda x: least(x, 0.1)))')} AS low, {Q.r('list_sum(list_transform(v, lambda x: (x - 0.5) / 4))')} AS scaled FROM v"""
)
def vec_elementwise(spark, sf):
    v = F.col("v")
    total = lambda a: r6(F.aggregate(a, F.lit(0.0), lambda s, x: s + x))
    return _vectors(spark, sf).select(
        "vec_id",
        total(T.add(T.add(v, v), 1.0)).alias("added"),
        total(T.maximum(v, 0.1)).alias("top"),
        total(T.minimum(v, 0.1)).alias("low"),
        total(T.divide(T.subtract(v, 0.5), 4.0)).alias("scaled"),
    )


@query(
    f"""WITH {_VEC}, q AS (SELECT v AS w FROM v WHERE vec_id = (SELECT min(vec_id) FROM v))
SELECT vec_id, {Q.r('list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))')} AS dist, {Q.r('list_sum(list_transform(list_zip(v, w), lambda p: p[1] * p[2]))')} AS prod,
 list_bool_and(list_transform(list_zip(v, w), lambda p: abs(p[1] - p[2]) <= 0.3)) AS near FROM v, q"""
)
def vec_distance(spark, sf):
    v = _vectors(spark, sf)
    first = v.agg(F.min_by("v", "vec_id").alias("w"))
    pairs = v.join(F.broadcast(first))  # one row
    a, b = F.col("v"), F.col("w")
    return pairs.select("vec_id", r6(T.squared_distance(a, b)).alias("dist"), r6(T.dot(a, b)).alias("prod"), T.close(a, b, 0.3).alias("near"))


@query(f"WITH {_VEC} SELECT vec_id, (a.range * 4 + b.range)::INTEGER AS k, {Q.r('v[a.range + 1] * v[b.range + 5]')} AS value FROM v, range(4) a, range(4) b")
def tensor_outer(spark, sf):
    v = F.col("v")
    out = T.outer(F.slice(v, 1, 4), F.slice(v, 5, 4))
    return _vectors(spark, sf).select("vec_id", F.posexplode(out).alias("k", "value")).select("vec_id", "k", r6("value").alias("value"))


@query(f"WITH {_VEC} SELECT vec_id, k::INTEGER AS k, {Q.r('v[k + 1] * v[64 - k]')} AS value FROM v, (SELECT range AS k FROM range(64))")
def tensor_hadamard(spark, sf):
    out = T.hadamard(F.col("v"), F.reverse("v"))
    return _vectors(spark, sf).select("vec_id", F.posexplode(out).alias("k", "value")).select("vec_id", "k", r6("value").alias("value"))


@query(f"WITH {_VEC} SELECT vec_id, (a.range * 4 + c.range)::INTEGER AS k, {Q.r('sum(v[a.range * 16 + b.range * 4 + c.range + 1] * (b.range + 1))')} AS value FROM v, range(4) a, range(4) b, range(4) c GROUP BY vec_id, a.range, c.range")
def tensor_contract(spark, sf):
    out = T.contract(F.col("v"), F.array(*(F.lit(float(i)) for i in (1, 2, 3, 4))), (4, 4, 4), 1)
    return _vectors(spark, sf).select("vec_id", F.posexplode(out).alias("k", "value")).select("vec_id", "k", r6("value").alias("value"))


@query(f"WITH {_VEC} SELECT vec_id, k::INTEGER AS k, {Q.r('v[k + 1] * ((k // 4) % 4 + 1)')} AS value FROM v, (SELECT range AS k FROM range(64))")
def tensor_scale_along(spark, sf):
    out = T.scale_along(F.col("v"), F.array(*(F.lit(float(i)) for i in (1, 2, 3, 4))), (4, 4, 4), 1)
    return _vectors(spark, sf).select("vec_id", F.posexplode(out).alias("k", "value")).select("vec_id", "k", r6("value").alias("value"))


@query(
    f"WITH {_VEC} SELECT vec_id, (o.range * 16 + b.range * 4 + c.range)::INTEGER AS k, {Q.r('sum(v[a.range * 16 + b.range * 4 + c.range + 1] * v[o.range * 4 + a.range + 1])')} AS value FROM v, range(4) o, range(4) a, range(4) b, range(4) c GROUP BY ALL"
)
def tensor_derivative_contraction(spark, sf):
    out = T.apply_matrix(F.col("v"), F.slice("v", 1, 16), (4, 4, 4), 0)
    return _vectors(spark, sf).select("vec_id", F.posexplode(out).alias("k", "value")).select("vec_id", "k", r6("value").alias("value"))


@query(f"WITH {_VEC} SELECT vec_id, (a.range * 8 + b.range)::INTEGER AS k, {Q.r('sum(v[a.range * 8 + m.range + 1] * v[m.range * 8 + b.range + 1])')} AS value FROM v, range(8) a, range(8) b, range(8) m GROUP BY ALL")
def matmul(spark, sf):
    out = T.matmul(F.col("v"), F.col("v"), 8, 8, 8)
    return _vectors(spark, sf).select("vec_id", F.posexplode(out).alias("k", "value")).select("vec_id", "k", r6("value").alias("value"))


@query(f"WITH {_VEC} SELECT vec_id, (a.range * 3 + b.range)::INTEGER AS k, {Q.r('v[a.range + 1]')} AS p, {Q.r('v[b.range + 1]')} AS q FROM v, range(3) a, range(3) b")
def cartesian_expansion(spark, sf):
    out = T.cartesian(F.slice("v", 1, 3), 2)
    return _vectors(spark, sf).select("vec_id", F.posexplode(out).alias("k", "t")).select("vec_id", "k", r6(F.col("t")[0]).alias("p"), r6(F.col("t")[1]).alias("q"))


@query(f"WITH {_VEC} SELECT vec_id, {Q.r('(SELECT sum(v[i.range * 16 + j.range * 4 + k.range + 1]) FROM range(0, 4, 2) i, range(1, 3) j, range(0, 3) k)')} AS total FROM v")
def tensor_slice(spark, sf):
    part = T.slice_shaped(F.col("v"), (4, 4, 4), (0, 1, 0), (4, 3, -2), (2, 1, 1))
    return _vectors(spark, sf).select("vec_id", r6(F.aggregate(part, F.lit(0.0), lambda s, x: s + x)).alias("total"))


# --- discontinuous Galerkin ---------------------------------------------------------------------

DG2 = dg.Config(order=2)
LINEAR = dg.LinearAdvection((1.0, 1.0))


def _dofs(spark, sf) -> DataFrame:
    points = basis.tensor_points(2, 2)
    nodes = F.array(*(F.col("u") * F.lit(float(1 + 0.2 * px + 0.1 * py)) for py, px in points))
    return S.grid(spark, sf).select("g", "x", "y", nodes.alias("u"))


def _long(cells: DataFrame, digits: int = 6) -> DataFrame:
    return cells.select("g", "x", "y", F.posexplode("u").alias("k", "v")).select("g", "x", "y", "k", r6("v", digits).alias("v"))


@query(f"WITH {Q.DG} SELECT g, x, y, k, {Q.r('v')} AS v FROM q0")
def dg_project(spark, sf):
    return _long(_dofs(spark, sf))


@query(f"WITH {Q.DG} SELECT g, x, y, {Q.r('any_value(u) * (1 + 0.2 * 0.25 + 0.1 * 0.75)')} AS v, {Q.r('avg(v)')} AS mean FROM q0 JOIN grid USING (g, x, y) GROUP BY g, x, y")
def lagrange_eval(spark, sf):
    u = F.col("u")
    return _dofs(spark, sf).select("g", "x", "y", r6(dg.evaluate(DG2, u, (0.75, 0.25))).alias("v"), r6(dg.cell_average(u, 4)).alias("mean"))


@query(f"WITH {Q.DG}, {Q.dg_rhs('q0', 'd0')} SELECT g, x, y, k, {Q.r('v')} AS v FROM d0")
def dg_rhs(spark, sf):
    return _long(dg.rhs(_dofs(spark, sf), DG2, LINEAR, BY))


_VOL = {
    (i, j): w
    for (i, j), w in (
        ((a * 2 + b, c * 2 + d), (basis.derivative_matrix(2)[b, d] * 0.25 * (a == c) + basis.derivative_matrix(2)[a, c] * 0.25 * (b == d)) / 64)
        for a in range(2)
        for b in range(2)
        for c in range(2)
        for d in range(2)
    )
    if w
}


@query(f"WITH {Q.DG}, vol(o, k, w) AS (VALUES {', '.join(f'({i}, {j}, {float(w)!r}::DOUBLE)' for (i, j), w in _VOL.items())}) SELECT g, x, y, o AS k, {Q.r('sum(w * v)', 9)} AS v FROM q0 JOIN vol USING (k) GROUP BY ALL")
def dg_volume_term(spark, sf):
    u = F.col("u")
    return _long(_dofs(spark, sf).select("g", "x", "y", dg.volume_term(DG2, [T.multiply(u, 1.0), T.multiply(u, 1.0)]).alias("u")), 9)


@query(
    f"""WITH {Q.DG}, face AS (SELECT g, x, y, k // 2 AS t, sum(v * CASE k % 2 WHEN 0 THEN (1 - sqrt(3)) / 2 ELSE (1 + sqrt(3)) / 2 END) AS hi, sum(v * CASE k % 2 WHEN 1 THEN (1 - sqrt(3)) / 2 ELSE (1 + sqrt(3)) / 2 END) AS lo FROM q0 GROUP BY ALL)
SELECT a.g, a.x, a.y, a.t::INTEGER AS k, {Q.r('((a.hi + b.lo) / 2 + (a.hi - b.lo) / 2) / 64')} AS v FROM face a JOIN face b ON b.g = a.g AND b.x = (a.x + 1) % 64 AND b.y = a.y AND a.t = b.t"""
)
def dg_face_flux(spark, sf):
    cells = _dofs(spark, sf)
    right = cells.select("g", ((F.col("x") + 63) % 64).alias("x"), "y", F.col("u").alias("w"))
    a, b = dg.to_face(DG2, F.col("u"), 0, True), dg.to_face(DG2, F.col("w"), 0, False)
    flux = dg.rusanov(a, b, a, b, F.lit(1.0), 1, DG2.edge)
    return _long(cells.join(right, ["g", "x", "y"]).select("g", "x", "y", flux.alias("u")))


def _integrated(stages: tuple, dt: float = 0.001) -> str:
    out = [Q.DG]
    for n, (keep, new) in enumerate(stages):
        out.append(Q.dg_rhs(f"q{n}", f"d{n}"))
        out.append(
            f"q{n + 1} AS MATERIALIZED (SELECT a.g, a.x, a.y, a.k, {keep!r}::DOUBLE * z.v + {new!r}::DOUBLE * (a.v + {dt} * d.v) AS v FROM q{n} a JOIN d{n} d USING (g, x, y, k) JOIN q0 z USING (g, x, y, k))"
        )
    return ",\n".join(out) + f" SELECT g, x, y, k, {Q.r('v')} AS v FROM q{len(stages)}"


@query("WITH " + _integrated(dg.INTEGRATORS["euler"]))
def dg_euler_step(spark, sf):
    return _long(dg.advance(_dofs(spark, sf), DG2, LINEAR, 0.001, "euler", BY))


@query("WITH " + _integrated(dg.INTEGRATORS["ssprk2"]))
def dg_ssprk2_step(spark, sf):
    checkpoints(spark)
    return _long(dg.advance(_dofs(spark, sf), DG2, LINEAR, 0.001, "ssprk2", BY))


@query("WITH " + _integrated(dg.INTEGRATORS["ssprk3"]))
def dg_ssprk3_step(spark, sf):
    checkpoints(spark)
    return _long(dg.advance(_dofs(spark, sf), DG2, LINEAR, 0.001, "ssprk3", BY))


@query(
    f"""WITH {Q.DG}, ind AS (SELECT g, x, y, (max(v) - min(v)) / (abs(avg(1 + v / 1000)) + 1e-10) AS d FROM q0 GROUP BY g, x, y)
SELECT {Q.enc(['(x // 8) * 16', '(y // 8) * 16'], '3', 'g')} AS patch_id, CASE WHEN bool_or(d > m * 1.6) THEN 'refine' WHEN bool_and(d < m * 1.45) THEN 'coarsen' ELSE 'stable' END AS status
FROM ind, (SELECT avg(d) AS m FROM ind) GROUP BY 1"""
)
def dg_decisions(spark, sf):
    u = F.col("u")
    rho = T.add(T.divide(u, 1000.0), 1.0)
    cut = lambda c: F.shiftleft(F.floor(F.col(c) / 8), 4)
    cells = _dofs(spark, sf).select(C2.encode([cut("x"), cut("y")], 3, F.col("g")).alias("patch_id"), dg.indicator([u], rho, 4).alias("indicator"))
    mean = cells.agg(F.avg("indicator").alias("mean"))  # one row
    return dg.patch_decisions(cells.join(F.broadcast(mean)), F.col("mean") * 1.6, F.col("mean") * 1.45)


@query(
    f"""WITH {Q.DG} SELECT g, x, y, c, k, {Q.r('any_value(u) * (1 + 0.2 * (nx / 2 + 0.5 * (c % 2)) + 0.1 * (ny / 2 + 0.5 * (c // 2)))')} AS v FROM grid, node, (SELECT range::INTEGER AS c FROM range(4)) GROUP BY g, x, y, c, k, nx, ny"""
)
def dg_prolong(spark, sf):
    # Child number of the table: bit 0 belongs to the first node dimension (y), bit 1 to the second.
    swap = [0, 2, 1, 3]
    sons = F.array(*(F.struct(F.lit(c).alias("c"), dg.prolong_dofs(DG2, F.col("u"), swap[c]).alias("w")) for c in range(4)))
    rows = _dofs(spark, sf).select("g", "x", "y", F.explode(sons).alias("s"))
    return rows.select("g", "x", "y", "s.c", F.posexplode("s.w").alias("k", "v")).select("g", "x", "y", "c", "k", r6("v").alias("v"))


@query(f"WITH {Q.DG} SELECT g, x, y, k, {Q.r('v')} AS v FROM q0")
def dg_restrict_of_prolong(spark, sf):
    u = F.col("u")
    back = dg.restrict_dofs(DG2, [dg.prolong_dofs(DG2, u, c) for c in range(4)])
    return _long(_dofs(spark, sf).select("g", "x", "y", back.alias("u")))


# --- checks and helpers -------------------------------------------------------------------------


@query(
    """SELECT name, count(*) FILTER (WHERE isnan(v)) AS n_nan, count(*) FILTER (WHERE isinf(v)) AS n_inf, count(*) FILTER (WHERE NOT isnan(v) AND NOT isinf(v) AND abs(v) > 50000) AS n_large, count(v) AS n
FROM (SELECT 'l_extendedprice' AS name, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'ratio', CASE WHEN l_tax = 0 THEN CASE WHEN l_discount = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END ELSE l_discount / l_tax END FROM lineitem) GROUP BY name"""
)
def anomaly_scan(spark, sf):
    line = S.read(spark, sf, "lineitem")
    ratio = F.when(F.col("l_tax") == 0, F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(
        F.col("l_discount") / F.col("l_tax")
    )
    return intergrid.anomalies(line.select("l_extendedprice", ratio.alias("ratio")), ["l_extendedprice", "ratio"], 50000.0)


@query(
    f"""SELECT o_orderkey AS o, {Q.r('greatest(1000.0, least(200000.0, o_totalprice))')} AS clamped, o_totalprice BETWEEN 1000 AND 200000 AS within, {Q.r('10.0 + 20.0 * greatest(0.0, least(1.0, (o_totalprice - 1000.0) / 199000.0))')} AS lerped,
 (o_totalprice - 100000 < 0) = (o_orderkey % 3 - 1 < 0) AS same_sign, {Q.r('ln(o_totalprice + 1) / ln(2.0)')} AS log2, (o_custkey % 7) * (o_custkey % 7) * (o_custkey % 7) AS cube,
 CASE WHEN o_custkey > 1 THEN length(bin(o_custkey - 1)) ELSE 0 END::INTEGER AS bits, CASE WHEN o_totalprice = floor(o_totalprice) AND o_totalprice < 2147483648 THEN o_totalprice::INTEGER END AS whole FROM orders"""
)
def clamp_lerp(spark, sf):
    p = F.col("o_totalprice")
    return S.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("o"),
        r6(numeric.clamp(p, 1000.0, 200000.0)).alias("clamped"),
        numeric.inside(p, 1000, 200000).alias("within"),
        r6(numeric.lerp(10.0, 30.0, numeric.unlerp(1000.0, 200000.0, p))).alias("lerped"),
        numeric.same_sign(p - 100000, F.col("o_orderkey") % 3 - 1).alias("same_sign"),
        r6(numeric.log_base(p + 1, 2)).alias("log2"),
        numeric.int_power(F.col("o_custkey") % 7, 3).alias("cube"),
        numeric.bits_for(F.col("o_custkey")).alias("bits"),
        numeric.safe_cast(p, "int", "double").alias("whole"),
    )


@query(f"WITH RECURSIVE {Q.passes(3)} SELECT patch_id, repeat('  ', level) || 'level ' || level || ' at ' || x || ',' || y AS line FROM leaf3")
def structured_print(spark, sf):
    checkpoints(spark)
    return tree.indent(S.leaf_set(spark, sf))


# --- patch grain and streams ----------------------------------------------------------------------


@query(f"WITH {Q.advect(8)} SELECT g, x, y, {Q.r('u')} AS u FROM s8")
def fvm_blocks_8_steps(spark, sf):
    from ..operators.blocks import AdvectionKernel, run_blocks

    checkpoints(spark)
    out = run_blocks(S.grid(spark, sf), AdvectionKernel(), 64, DT, 8, n=16, per_round=4, by="g")
    return out.select("g", "x", "y", r6("u").alias("u"))


@query(
    f"""SELECT date_trunc('day', ts) AS start, {Q.enc(['(floor(value)::BIGINT % 128) // 16 * 16', '(floor(value * 3)::BIGINT % 128) // 16 * 16'], '3')} AS patch_id, count(*) AS n
FROM events GROUP BY ALL"""
)
def stream_point_counts(spark, sf):
    """The windows of a stream that has ended: a watermark far behind closes none too early."""
    from ..streaming import points as P

    stream = P.to_points(P.read_events(spark, f"{sf}/event[s].parquet"))
    counts = P.windowed_counts(stream, C2, 3, "1 day", "10 minutes")
    return loops.drained(spark, counts, ["start", "patch_id"])


# --- octrees ------------------------------------------------------------------------------------

octree.register(query, checkpoints)
stored.register(query, checkpoints)
meshes.register(query, checkpoints)
arrays.register(query, checkpoints)
lookups.register(query, checkpoints)
