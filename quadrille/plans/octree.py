"""Queries over the octree of the events, and keys in three dimensions, each beside its SQL."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import intergrid, tree
from ..sources import tables as S
from . import loops
from . import sql as Q

C3, N, AXES = S.CODEC3, S.PATCH3, tree.AXES
_OFFSETS = ", ".join(f"({', '.join(map(str, p))})" for p in product((0, 1), repeat=3))
_FACES = "(VALUES " + ", ".join(f"({', '.join(map(str, d))})" for d in tree.directions(3)) + ") d(dir, dx, dy, dz)"


def _all(text: str, between: str = " AND ") -> str:
    """The text for x, y and z in turn."""
    return between.join(text.replace("@", a) for a in AXES)


def _each(text: str) -> str:
    return _all(text, ", ")


def _key(text: str, level: str, tree: str = "") -> str:
    return Q.enc([text.replace("@", a) for a in AXES], level, tree)


def _neighbors(k: int) -> str:
    lower = {0: "z", 1: "y", 2: "x"}
    touch = " ".join(f"WHEN {2 * d + p} THEN l.{a} {'=' if p else '<>'} w.n{a}" for d, a in lower.items() for p in (0, 1))
    return f"""wish{k} AS MATERIALIZED (SELECT l.patch_id, l.level, l.g, l.s, d.dir, {_each(f'(l.@ + d.d@ * l.s + 128) % 128 AS n@')} FROM leaf{k} l, {_FACES}),
nbr{k} AS MATERIALIZED (
  SELECT w.patch_id, w.dir, 'same' AS relation, l.patch_id AS n_id FROM wish{k} w JOIN leaf{k} l ON l.g = w.g AND l.level = w.level AND {_all('l.@ = w.n@')}
  UNION ALL SELECT w.patch_id, w.dir, 'coarser', l.patch_id FROM wish{k} w JOIN leaf{k} l ON l.g = w.g AND l.level = w.level - 1 AND {_all('l.@ = w.n@ - w.n@ % (2 * w.s)')}
  UNION ALL SELECT w.patch_id, w.dir, 'finer', l.patch_id FROM wish{k} w JOIN leaf{k} l ON l.g = w.g AND l.level = w.level + 1 AND {_all('l.@ - l.@ % (2 * l.s) = w.n@')}
    WHERE CASE w.dir {touch} END)"""


def _passes(number: int) -> str:
    """CTEs up to the leaf set after ``number`` passes, and the flags of one more."""
    out = [
        f"points AS MATERIALIZED (SELECT event_id // {Q.GROUP} AS g, floor(value)::BIGINT % 128 AS x, floor(value * 3)::BIGINT % 128 AS y, user_id % 128 AS z FROM events)",
        "totals AS MATERIALIZED (SELECT g, count(*) AS total FROM points GROUP BY g)",
        f"leaf0 AS MATERIALIZED (SELECT {_key('@', '2', 'g')} AS patch_id, 2 AS level, g, x, y, z, 32 AS s FROM (SELECT g, a.range * 32 AS x, b.range * 32 AS y, c.range * 32 AS z FROM (SELECT DISTINCT g FROM points), range(4) a, range(4) b, range(4) c))",
    ]
    for k, share in enumerate(S.PASSES3[:number]):
        out += [
            f"""hits{k} AS MATERIALIZED (SELECT l.patch_id, count(*) AS n FROM leaf{k} l JOIN points p ON p.g = l.g AND {_all('p.@ >= l.@ AND p.@ < l.@ + l.s')} GROUP BY l.patch_id),
flag{k} AS MATERIALIZED (SELECT l.patch_id, l.level, l.g, {_each('l.@')}, l.s, CASE WHEN coalesce(h.n, 0) * {share} > t.total AND l.level < 7 THEN 'refine'
    WHEN coalesce(h.n, 0) * {share} * 4 <= t.total THEN 'coarsen' ELSE 'stable' END AS status
  FROM leaf{k} l JOIN totals t ON t.g = l.g LEFT JOIN hits{k} h ON h.patch_id = l.patch_id)""",
            _neighbors(k),
            f"""r{k}(patch_id) AS (SELECT patch_id FROM flag{k} WHERE status = 'refine'
  UNION SELECT n.n_id FROM r{k} JOIN nbr{k} n ON n.patch_id = r{k}.patch_id AND n.relation = 'coarser')""",
            f"""fam{k} AS MATERIALIZED (SELECT level - 1 AS level, g, {_each('@ - @ % (2 * s) AS @')}, 2 * s AS s FROM flag{k} WHERE level > {S.MIN_LEVEL3}
  GROUP BY ALL HAVING count(*) = 8 AND bool_and(status = 'coarsen'))""",
            f"""ok{k} AS MATERIALIZED (SELECT f.* FROM fam{k} f WHERE NOT EXISTS (SELECT 1 FROM leaf{k} l JOIN nbr{k} n ON n.patch_id = l.patch_id
    LEFT JOIN r{k} ON r{k}.patch_id = n.n_id WHERE l.g = f.g AND l.level = f.level + 1 AND {_all('l.@ - l.@ % f.s = f.@')}
      AND (n.relation = 'finer' OR (n.relation = 'same' AND r{k}.patch_id IS NOT NULL))))""",
            f"""leaf{k + 1} AS MATERIALIZED (
  SELECT l.patch_id, l.level, l.g, {_each('l.@')}, l.s FROM leaf{k} l LEFT JOIN r{k} r ON r.patch_id = l.patch_id
    LEFT JOIN ok{k} f ON f.g = l.g AND f.level + 1 = l.level AND {_all('f.@ = l.@ - l.@ % (2 * l.s)')} WHERE r.patch_id IS NULL AND f.g IS NULL
  UNION ALL SELECT {_key('@ + c@ * (s // 2)', 'level + 1', 'g')}, level + 1, g, {_each('@ + c@ * (s // 2)')}, s // 2
    FROM (SELECT l.* FROM leaf{k} l JOIN r{k} USING (patch_id)), (VALUES {_OFFSETS}) c(cx, cy, cz)
  UNION ALL SELECT {_key('@', 'level', 'g')}, level, g, {_each('@')}, s FROM ok{k})""",
        ]
    return "WITH RECURSIVE " + ",\n".join(out)


_IN = "FROM range(4) a, range(4) b"
_CELLS = f"""grid3 AS MATERIALIZED (SELECT p.g, p.x, p.y, p.z, coalesce(u, 0.0) AS u FROM (SELECT o.g, a.range AS x, b.range AS y, c.range AS z FROM (SELECT DISTINCT l_orderkey // {Q.GROUP} AS g FROM lineitem) o, range(32) a, range(32) b, range(32) c) p
  LEFT JOIN (SELECT l_orderkey // {Q.GROUP} AS g, l_partkey % 32 AS x, l_suppkey % 32 AS y, l_orderkey % 32 AS z, sum(l_quantity) AS u FROM lineitem GROUP BY 1, 2, 3, 4) g ON g.g = p.g AND {_all('g.@ = p.@')}),
places AS MATERIALIZED (SELECT l.patch_id, l.level, l.g, c.k, c.j, c.i, l.s // 4 AS w, l.x + c.i * (l.s // 4) AS cx, l.y + c.j * (l.s // 4) AS cy, l.z + c.k * (l.s // 4) AS cz,
    (2 * l.x + (2 * c.i + 1) * (l.s // 4)) // 8 AS x, (2 * l.y + (2 * c.j + 1) * (l.s // 4)) // 8 AS y, (2 * l.z + (2 * c.k + 1) * (l.s // 4)) // 8 AS z
  FROM leaf2 l CROSS JOIN (SELECT a.range::INTEGER AS k, b.range::INTEGER AS j, c.range::INTEGER AS i FROM range(4) a, range(4) b, range(4) c) c),
cells AS MATERIALIZED (SELECT patch_id, level, g, k, j, i, w, cx, cy, cz, u FROM places JOIN grid3 USING (g, x, y, z))"""
_WANT = " UNION ALL ".join(
    f"SELECT {2 * d + p} AS dir, " + ", ".join(f"{4 if p else -1} AS {m}" if m == at else f"{next(names)} AS {m}" for m in tree.INDICES) + f" {_IN}"
    for d, at in enumerate(tree.INDICES)
    for p in (0, 1)
    for names in [iter(["a.range::INTEGER", "b.range::INTEGER"])]
)
CELLS_SQL = f"{_passes(2)}, {_CELLS}"
#: Each step is worked out once, and each case joined by itself, so that times do not depend on the planner's guesses.
HALO_CTES = f"""{CELLS_SQL},
want AS MATERIALIZED (SELECT l.patch_id, l.g, d.dir, d.k, d.j, d.i, l.s // 4 AS w, (l.x + d.i * (l.s // 4) + 128) % 128 AS hx, (l.y + d.j * (l.s // 4) + 128) % 128 AS hy, (l.z + d.k * (l.s // 4) + 128) % 128 AS hz
  FROM leaf2 l CROSS JOIN ({_WANT}) d),
placed AS MATERIALIZED (SELECT g * 2097152 + cx * 16384 + cy * 128 + cz AS at, w, u FROM cells),
above AS MATERIALIZED (SELECT g * 2097152 + (cx - cx % (2 * w)) * 16384 + (cy - cy % (2 * w)) * 128 + cz - cz % (2 * w) AS at, 2 * w AS w, avg(u) AS u, count(*) AS n FROM cells GROUP BY 1, 2),
asked AS MATERIALIZED (SELECT patch_id, dir, k, j, i, w, g * 2097152 + hx * 16384 + hy * 128 + hz AS at,
    g * 2097152 + (hx - hx % (2 * w)) * 16384 + (hy - hy % (2 * w)) * 128 + hz - hz % (2 * w) AS wide FROM want),
same_halo AS MATERIALIZED (SELECT h.patch_id, h.dir, h.k, h.j, h.i, 'same' AS relation, c.u FROM asked h JOIN placed c ON c.at = h.at AND c.w = h.w),
coarser_halo AS MATERIALIZED (SELECT h.patch_id, h.dir, h.k, h.j, h.i, 'coarser' AS relation, c.u FROM asked h JOIN placed c ON c.at = h.wide AND c.w = 2 * h.w),
finer_halo AS MATERIALIZED (SELECT h.patch_id, h.dir, h.k, h.j, h.i, 'finer' AS relation, c.u FROM asked h JOIN above c ON c.at = h.at AND c.w = h.w WHERE c.n = 8),
halo AS MATERIALIZED (SELECT * FROM same_halo UNION ALL SELECT * FROM coarser_halo UNION ALL SELECT * FROM finer_halo)"""
HALO_SQL = f"{HALO_CTES} SELECT patch_id, dir, k, j, i, relation, {Q.r('u')} AS u FROM halo"


def _r6(c: str):
    return F.round(c, 6) + F.lit(0.0)


def register(query, checkpoints) -> None:
    """Adds the queries by the decorator of ``plans.queries``."""

    @query(f"{_passes(2)} SELECT patch_id, level, x, y, z FROM leaf2")
    def octree_leaves(spark, sf):
        checkpoints(spark)
        return S.octree(spark, sf)[0].select("patch_id", "level", *AXES)

    @query(f"{_passes(2)}, {_neighbors(2)} SELECT patch_id, dir, relation, n_id FROM nbr2")
    def octree_neighbors(spark, sf):
        checkpoints(spark)
        return tree.neighbors(S.octree(spark, sf)[0], C3)

    @query(f"{_passes(2)} SELECT patch_id FROM r1")
    def octree_balance(spark, sf):
        checkpoints(spark)
        leaves, flags = S.octree(spark, sf, 1)[0], S.octree(spark, sf, 2)[1]
        return tree.balance_refinement(tree.eligible(flags, C3), leaves, C3)

    @query(
        f"{_passes(2)}, {_CELLS} SELECT {_key('c@ - c@ % (8 * w)', 'level - 1', 'g')} AS patch_id, ((cz // (2 * w)) % 4)::INTEGER AS k, ((cy // (2 * w)) % 4)::INTEGER AS j, ((cx // (2 * w)) % 4)::INTEGER AS i, "
        f"{Q.r('avg(u)')} AS u, max(u) AS top FROM cells WHERE level > 0 GROUP BY ALL HAVING count(*) = 8"
    )
    def octree_restrict(spark, sf):
        """Whole families only: blocks of eight fine cells."""
        checkpoints(spark)
        patches = S.octree_patches(spark, sf, S.octree(spark, sf)[0])
        mean = lambda v: reduce(Column.__add__, v) / len(v)
        found = intergrid.restrict_patches(patches, C3, N, {"mean": ("u", mean), "top": ("u", lambda v: F.greatest(*v))})
        return found.select("patch_id", *tree.INDICES, _r6("mean").alias("u"), "top")

    @query(
        f"{_passes(2)}, {_CELLS} SELECT {_key('(c@ + p@ * (w // 2)) - (c@ + p@ * (w // 2)) % (2 * w)', 'level + 1', 'g')} AS patch_id, "
        f"(((cz + pz * (w // 2)) // (w // 2)) % 4)::INTEGER AS k, (((cy + py * (w // 2)) // (w // 2)) % 4)::INTEGER AS j, (((cx + px * (w // 2)) // (w // 2)) % 4)::INTEGER AS i, "
        f"{Q.r('u + 0.25 * (px - 0.5) + 0.5 * (pz - 0.5)')} AS u FROM cells, (VALUES {_OFFSETS}) p(px, py, pz)"
    )
    def octree_prolong(spark, sf):
        """With an operator of its own: a slope along x and z instead of copies."""
        checkpoints(spark)
        patches = S.octree_patches(spark, sf, S.octree(spark, sf)[0])
        fine = intergrid.prolong_patches(patches, C3, N, ["u"], spread=lambda u, at: u + (at[2] - 0.5) * 0.25 + (at[0] - 0.5) * 0.5)
        return fine.select("patch_id", *tree.INDICES, _r6("u").alias("u"))

    @query(f"WITH {Q.KEYS} SELECT o, n, {_key('@ - @ % (2 * s)', 'n - 1')} AS parent, ((x // s) % 2 + 2 * ((y // s) % 2) + 4 * ((z // s) % 2))::INTEGER AS off FROM keys")
    def octree_parent(spark, sf):
        key = F.col("key")
        return _keys3(spark, sf).select("o", "n", C3.parent(key).alias("parent"), C3.offset_of(key).alias("off"))

    @query(f"WITH {Q.KEYS} SELECT o, n, (cx + 2 * cy + 4 * cz)::INTEGER AS k, {_key('@ + c@ * (s // 2)', 'n + 1')} AS child FROM keys, (VALUES {_OFFSETS}) c(cx, cy, cz) WHERE n < 7")
    def octree_children(spark, sf):
        return _keys3(spark, sf).filter("n < 7").select("o", "n", F.posexplode(C3.children(F.col("key"))).alias("k", "child"))

    @query(
        f"WITH {Q.KEYS} SELECT o, n, dir, CASE WHEN {_all('@ + d@ * s BETWEEN 0 AND 127')} THEN {_key('@ + d@ * s', 'n')} END AS open, {_key('(@ + d@ * s + 128) % 128', 'n')} AS wrapped FROM keys, {_FACES}"
    )
    def octree_key_neighbors(spark, sf):
        faces = F.array(
            *(
                F.struct(F.lit(d).alias("dir"), C3.neighbor(F.col("key"), step).alias("open"), C3.neighbor(F.col("key"), step, periodic=True).alias("wrapped"))
                for d, *step in tree.directions(3)
            )
        )
        return _keys3(spark, sf).select("o", "n", F.explode(faces).alias("f")).select("o", "n", "f.*")

    @query(f"WITH {Q.KEYS}, k AS (SELECT DISTINCT {_key('@', 'n')} AS key FROM keys) SELECT (SELECT bool_and(key > before) FROM (SELECT key, lag(key, 1, -1) OVER (ORDER BY key) AS before FROM k)) AS sorted, 0::BIGINT AS faults")
    def index_checks(spark, sf):
        """Keys numbered in their order are sorted, and their map of places has no fault."""
        checkpoints(spark)
        distinct = _keys3(spark, sf).select(F.col("key").alias("patch_id")).distinct()
        placed = loops.row_numbers(distinct).checkpoint()
        faults = tree.index_faults(distinct, placed.select("patch_id", "place")).agg(F.count("*").alias("faults"))
        return tree.is_sorted(placed).join(F.broadcast(faults)).select("sorted", "faults")

    @query(
        f"WITH {Q.KEYS}, k AS (SELECT DISTINCT {_key('@', 'n')} AS key FROM keys), p AS (SELECT key, row_number() OVER (ORDER BY key) AS place FROM k), "
        "m AS MATERIALIZED (SELECT key, place - CASE WHEN key % 7 = 0 THEN 1 ELSE 0 END AS place FROM p WHERE key % 11 <> 0) "
        "SELECT f.patch_id, (SELECT count(*) = max(place) AND min(place) = 1 AND count(DISTINCT place) = count(*) FROM m) AS sorted FROM "
        "(SELECT key AS patch_id FROM k WHERE key % 11 = 0 UNION SELECT min(key) FROM m GROUP BY place HAVING count(*) > 1) f"
    )
    def index_faults(spark, sf):
        """Faults put in: keys without a place, and keys that share the place before theirs."""
        checkpoints(spark)
        distinct = _keys3(spark, sf).select(F.col("key").alias("patch_id")).distinct()
        moved = F.col("place") - F.when(F.col("patch_id") % 7 == 0, 1).otherwise(0)
        places = loops.row_numbers(distinct).filter("patch_id % 11 <> 0").select("patch_id", moved.alias("place")).checkpoint()
        return tree.index_faults(distinct, places).join(F.broadcast(tree.is_sorted(places)))  # a single row


def _keys3(spark, sf):
    return S.keys(spark, sf).select("o", "n", C3.encode([F.col(a) for a in AXES], F.col("n")).alias("key"))
