"""SQL of the queries, written from coordinates and geometry rather than from key arithmetic."""

from __future__ import annotations

import numpy as np

DEPTH = 7


#: Orders, or events, of a grid or tree.
GROUP = 4096


def enc(coords: list[str], level: str, tree: str = "") -> str:
    n = len(coords)
    bits = [f"(((({c})::BIGINT >> {i}) & 1) << {n * i + a + 6})" for a, c in enumerate(coords) for i in range(DEPTH)]
    above = [f"(({tree})::BIGINT << {n * DEPTH + 6})"] if tree else []
    return "(" + " | ".join([*above, *bits, f"({level})::BIGINT"]) + ")"


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


KEYS = """keys AS (SELECT o, n, (x >> (7 - n)) << (7 - n) AS x, (y >> (7 - n)) << (7 - n) AS y, (z >> (7 - n)) << (7 - n) AS z, 1::BIGINT << (7 - n) AS s
  FROM (SELECT l_orderkey AS o, l_linenumber::INTEGER AS n, l_partkey % 128 AS x, l_suppkey % 128 AS y, l_orderkey % 128 AS z
        FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7))"""

PLACES = f"""(SELECT DISTINCT l_orderkey // {GROUP} AS g FROM lineitem) o CROSS JOIN (SELECT range AS x FROM range(64)) a CROSS JOIN (SELECT range AS y FROM range(64)) b"""

GRID = f"""grid AS MATERIALIZED (SELECT o.g, a.x, b.y, coalesce(u, 0.0) AS u FROM {PLACES}
  LEFT JOIN (SELECT l_orderkey // {GROUP} AS g, l_partkey % 64 AS x, l_orderkey % 64 AS y, sum(l_quantity) AS u FROM lineitem GROUP BY 1, 2, 3) v ON v.g = o.g AND v.x = a.x AND v.y = b.y)"""

GAS = f"""prim AS (SELECT o.g, a.x, b.y, 1 + coalesce(u, 0.0) / 1000 AS rho, coalesce(d, 0.0) * 0.7310585786300049 AS vx, coalesce(d, 0.0) * -0.2689414213699951 AS vy, 1 + coalesce(t, 0.0) AS p
  FROM {PLACES}
  LEFT JOIN (SELECT l_orderkey // {GROUP} AS g, l_partkey % 64 AS x, l_orderkey % 64 AS y, sum(l_quantity) AS u, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY 1, 2, 3) v
  ON v.g = o.g AND v.x = a.x AND v.y = b.y),
gas AS (SELECT g, x, y, rho, rho * vx AS mx, rho * vy AS my, p / 0.4 + 0.5 * rho * (vx * vx + vy * vy) AS e FROM prim)"""

PATCHES = f"""{GRID},
cells AS (SELECT g, {enc(['(x // 8) * 16', '(y // 8) * 16'], '3', 'g')} AS patch_id, 3 AS level, (y % 8)::INTEGER AS j, (x % 8)::INTEGER AS i, x, y, u FROM grid)"""


def passes(number: int) -> str:
    """CTEs up to the leaf set after ``number`` passes: leafK, nbrK, flagK, rK, famK, okK."""
    out = [
        f"points AS MATERIALIZED (SELECT event_id // {GROUP} AS g, floor(value)::BIGINT % 128 AS x, floor(value * 3)::BIGINT % 128 AS y FROM events)",
        "totals AS MATERIALIZED (SELECT g, count(*) AS total FROM points GROUP BY g)",
        f"leaf0 AS MATERIALIZED (SELECT {enc(['x', 'y'], '4', 'g')} AS patch_id, 4 AS level, g, x, y, 8 AS s FROM (SELECT g, a.range * 8 AS x, b.range * 8 AS y FROM (SELECT DISTINCT g FROM points), range(16) a, range(16) b))",
    ]
    for k, share in enumerate((90, 200, 400)[:number]):
        out += step(k, share)
        child = enc(["x + cx * (s // 2)", "y + cy * (s // 2)"], "level + 1", "g")
        own = enc(["x", "y"], "level", "g")
        out.append(
            f"""leaf{k + 1} AS MATERIALIZED (
  SELECT l.patch_id, l.level, l.g, l.x, l.y, l.s FROM leaf{k} l LEFT JOIN r{k} r ON r.patch_id = l.patch_id
    LEFT JOIN ok{k} f ON f.g = l.g AND f.level + 1 = l.level AND f.x = l.x - l.x % (2 * l.s) AND f.y = l.y - l.y % (2 * l.s) WHERE r.patch_id IS NULL AND f.g IS NULL
  UNION ALL SELECT {child}, level + 1, g, x + cx * (s // 2), y + cy * (s // 2), s // 2
    FROM (SELECT l.* FROM leaf{k} l JOIN r{k} USING (patch_id)), (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) c(cx, cy)
  UNION ALL SELECT {own}, level, g, x, y, s FROM ok{k})"""
        )
    return ",\n".join(out)


def nbr(k: int) -> str:
    return f"""wish{k} AS MATERIALIZED (SELECT l.patch_id, l.level, l.g, l.s, d.dir, (l.x + d.dx * l.s + 128) % 128 AS nx, (l.y + d.dy * l.s + 128) % 128 AS ny
  FROM leaf{k} l, (VALUES (0, 0, -1), (1, 0, 1), (2, -1, 0), (3, 1, 0)) d(dir, dx, dy)),
nbr{k} AS MATERIALIZED (
  SELECT w.patch_id, w.dir, 'same' AS relation, l.patch_id AS n_id FROM wish{k} w JOIN leaf{k} l ON l.g = w.g AND l.level = w.level AND l.x = w.nx AND l.y = w.ny
  UNION ALL SELECT w.patch_id, w.dir, 'coarser', l.patch_id FROM wish{k} w
    JOIN leaf{k} l ON l.g = w.g AND l.level = w.level - 1 AND l.x = w.nx - w.nx % (2 * w.s) AND l.y = w.ny - w.ny % (2 * w.s)
  UNION ALL SELECT w.patch_id, w.dir, 'finer', l.patch_id FROM wish{k} w
    JOIN leaf{k} l ON l.g = w.g AND l.level = w.level + 1 AND l.x - l.x % (2 * l.s) = w.nx AND l.y - l.y % (2 * l.s) = w.ny
    WHERE CASE w.dir WHEN 0 THEN l.y <> w.ny WHEN 1 THEN l.y = w.ny WHEN 2 THEN l.x <> w.nx ELSE l.x = w.nx END)"""


def step(k: int, share: int) -> list[str]:
    return [
        f"""hits{k} AS MATERIALIZED (SELECT l.patch_id, count(*) AS n FROM leaf{k} l
    JOIN points p ON p.g = l.g AND p.x >= l.x AND p.x < l.x + l.s AND p.y >= l.y AND p.y < l.y + l.s GROUP BY l.patch_id),
flag{k} AS MATERIALIZED (SELECT l.patch_id, l.level, l.g, l.x, l.y, l.s, CASE WHEN coalesce(h.n, 0) * {share} > t.total AND l.level < 7 THEN 'refine'
    WHEN coalesce(h.n, 0) * {share} * 4 <= t.total THEN 'coarsen' ELSE 'stable' END AS status
  FROM leaf{k} l JOIN totals t ON t.g = l.g LEFT JOIN hits{k} h ON h.patch_id = l.patch_id)""",
        nbr(k),
        f"""r{k}(patch_id) AS (SELECT patch_id FROM flag{k} WHERE status = 'refine'
  UNION SELECT n.n_id FROM r{k} JOIN nbr{k} n ON n.patch_id = r{k}.patch_id AND n.relation = 'coarser')""",
        f"""fam{k} AS MATERIALIZED (SELECT level - 1 AS level, g, x - x % (2 * s) AS x, y - y % (2 * s) AS y, 2 * s AS s FROM flag{k} WHERE level > 3
  GROUP BY ALL HAVING count(*) = 4 AND bool_and(status = 'coarsen'))""",
        f"""ok{k} AS MATERIALIZED (SELECT f.* FROM fam{k} f WHERE NOT EXISTS (SELECT 1 FROM leaf{k} l JOIN nbr{k} n ON n.patch_id = l.patch_id
    LEFT JOIN r{k} ON r{k}.patch_id = n.n_id
    WHERE l.g = f.g AND l.level = f.level + 1 AND l.x - l.x % f.s = f.x AND l.y - l.y % f.s = f.y
      AND (n.relation = 'finer' OR (n.relation = 'same' AND r{k}.patch_id IS NOT NULL))))""",
    ]


#: Cells of the last leaf set, with boxes in sixteenths of the finest unit.
LEAF_CELLS = f"""{passes(3)}, {GRID},
places AS MATERIALIZED (SELECT l.patch_id, l.level, l.g, c.j, c.i, l.s, l.x * 16 + c.i * 2 * l.s AS cx, l.y * 16 + c.j * 2 * l.s AS cy, 2 * l.s AS w,
    (l.x * 16 + (2 * c.i + 1) * l.s) // 32 AS x, (l.y * 16 + (2 * c.j + 1) * l.s) // 32 AS y
  FROM leaf3 l CROSS JOIN (SELECT a.range::INTEGER AS j, b.range::INTEGER AS i FROM range(8) a, range(8) b) c),
cells AS MATERIALIZED (SELECT patch_id, level, g, j, i, s, cx, cy, w, u FROM places JOIN grid USING (g, x, y))"""

HALO = f"""{LEAF_CELLS},
want AS MATERIALIZED (SELECT l.patch_id, l.level, l.g, d.dir, d.j, d.i, 2 * l.s AS w, (l.x * 16 + d.i * 2 * l.s + 2048) % 2048 AS hx, (l.y * 16 + d.j * 2 * l.s + 2048) % 2048 AS hy
  FROM leaf3 l CROSS JOIN (SELECT 0 AS dir, -1 AS j, range::INTEGER AS i FROM range(8) UNION ALL SELECT 1, 8, range::INTEGER FROM range(8)
    UNION ALL SELECT 2, range::INTEGER, -1 FROM range(8) UNION ALL SELECT 3, range::INTEGER, 8 FROM range(8)) d),
halo AS MATERIALIZED (
  SELECT h.patch_id, h.level, h.dir, h.j, h.i, 'same' AS relation, c.u FROM want h JOIN cells c ON c.g = h.g AND c.w = h.w AND c.cx = h.hx AND c.cy = h.hy
  UNION ALL SELECT h.patch_id, h.level, h.dir, h.j, h.i, 'coarser', c.u FROM want h
    JOIN cells c ON c.g = h.g AND c.w = 2 * h.w AND c.cx = h.hx - h.hx % (2 * h.w) AND c.cy = h.hy - h.hy % (2 * h.w)
  UNION ALL SELECT h.patch_id, h.level, h.dir, h.j, h.i, 'finer', avg(c.u) FROM want h
    JOIN cells c ON c.g = h.g AND 2 * c.w = h.w AND c.cx - c.cx % (2 * c.w) = h.hx AND c.cy - c.cy % (2 * c.w) = h.hy GROUP BY ALL)"""


def advect(steps: int, dt: str = "0.00390625") -> str:
    """CTEs s0..sN: upwind steps on the 64 by 64 grid with velocity (1, 0.5)."""
    out = [GRID, "s0 AS (SELECT g, x, y, u FROM grid)"]
    for k in range(steps):
        out.append(
            f"""s{k + 1} AS MATERIALIZED (SELECT a.g, a.x, a.y, a.u - {dt} * 64 * ((a.u - l.u) + 0.5 * (a.u - d.u)) AS u
  FROM s{k} a JOIN s{k} l ON l.g = a.g AND l.x = (a.x + 63) % 64 AND l.y = a.y JOIN s{k} d ON d.g = a.g AND d.x = a.x AND d.y = (a.y + 63) % 64)"""
        )
    return ",\n".join(out)


def euler_flux(left: str, right: str, axis: int, field: str) -> str:
    """Rusanov flux of one field between two aliases that carry p, a and the conserved fields."""
    m = ("mx", "my")[axis]
    top = f"greatest(abs({left}.{m} / {left}.rho) + {left}.a, abs({right}.{m} / {right}.rho) + {right}.a)"

    def f(s: str) -> str:
        along = f"({s}.{m} / {s}.rho)"
        if field == "rho":
            return f"{s}.{m}"
        if field == "e":
            return f"({along} * ({s}.e + {s}.p))"
        return f"({s}.{field} * {along}" + (f" + {s}.p)" if field == m else ")")

    return f"(0.5 * ({f(left)} + {f(right)} - {top} * ({right}.{field} - {left}.{field})))"


STATE = f"""{GAS},
state AS (SELECT *, 0.4 * (e - 0.5 * (mx * mx + my * my) / rho) AS p, sqrt(1.4 * 0.4 * (e - 0.5 * (mx * mx + my * my) / rho) / rho) AS a FROM gas)"""


def lagrange_matrices(order: int = 2) -> dict[tuple[int, int], np.ndarray]:
    """Nodal advection with velocity (1, 1) on cells of edge 1/64: out node from in node of the cell
    at each offset, from one-dimensional mass, stiffness and face matrices."""
    x, w = np.polynomial.legendre.leggauss(order)
    x, w = (x + 1) / 2, w / 2
    basis = [np.poly1d(np.poly(np.delete(x, i))) / np.prod(x[i] - np.delete(x, i)) for i in range(order)]
    low, high = np.array([b(0.0) for b in basis]), np.array([b(1.0) for b in basis])
    slope = np.array([[b.deriv()(p) for p in x] for b in basis])
    h = 1 / 64
    # d/dt u = (stiffness - outflow) u + inflow u_left, each divided by the mass; flow to the right.
    own = (slope * w - np.outer(high, high)) / w[:, None] / h
    left = np.outer(low, high) / w[:, None] / h
    eye = np.eye(order)
    return {
        (0, 0): np.kron(own, eye) + np.kron(eye, own),
        (-1, 0): np.kron(eye, left),
        (0, -1): np.kron(left, eye),
    }


def dg_table() -> str:
    rows = [
        f"({dx}, {dy}, {i}, {j}, {float(m[i, j])!r}::DOUBLE)"
        for (dx, dy), m in lagrange_matrices().items()
        for i in range(4)
        for j in range(4)
        if m[i, j]
    ]
    return "op(dx, dy, o, k, w) AS (VALUES " + ", ".join(rows) + ")"


def dg_nodes() -> str:
    x = (np.polynomial.legendre.leggauss(2)[0] + 1) / 2
    rows = [f"({2 * j + i}, {float(x[j])!r}::DOUBLE, {float(x[i])!r}::DOUBLE)" for j in range(2) for i in range(2)]
    return "node(k, ny, nx) AS (VALUES " + ", ".join(rows) + ")"


DG = f"{GRID}, {dg_nodes()}, {dg_table()},\nq0 AS (SELECT g, x, y, k, u * (1 + 0.2 * nx + 0.1 * ny) AS v FROM grid, node)"


def dg_rhs(source: str, name: str) -> str:
    """Each node's value to the nodes that it takes part in."""
    return f"""{name} AS MATERIALIZED (SELECT s.g, (s.x - op.dx + 64) % 64 AS x, (s.y - op.dy + 64) % 64 AS y, op.o AS k, sum(op.w * s.v) AS v
  FROM {source} s JOIN op ON s.k = op.k GROUP BY ALL)"""
