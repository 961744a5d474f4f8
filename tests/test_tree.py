"""Leaf sets against a plain model, and what must hold of any of them."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.functions.morton import MortonCodec
from quadrille.functions.physics import Advection
from quadrille.operators import fvm, halo, intergrid, tree
from quadrille.operators.layout import PatchLayout
from quadrille.sources import tables as S

CODEC = MortonCodec(2, 5)
M = 1 << CODEC.depth


class Model:
    """Leaves as a set of (level, x, y); one step at a time, in plain Python."""

    def __init__(self, leaves):
        self.leaves = set(leaves)

    @staticmethod
    def side(level):
        return 1 << (CODEC.depth - level)

    def neighbours(self, leaf):
        level, x, y = leaf
        s = self.side(level)
        for d, dx, dy in tree.DIRECTIONS:
            nx, ny = (x + dx * s) % M, (y + dy * s) % M
            if (level, nx, ny) in self.leaves:
                yield d, "same", (level, nx, ny)
                continue
            up = (level - 1, nx - nx % (2 * s), ny - ny % (2 * s))
            if up in self.leaves:
                yield d, "coarser", up
                continue
            h = s // 2
            for cx in (0, 1):
                for cy in (0, 1):
                    touches = {0: cy == 1, 1: cy == 0, 2: cx == 1, 3: cx == 0}[d]
                    if touches:
                        yield d, "finer", (level + 1, nx + cx * h, ny + cy * h)

    def reconstruct(self, flags):
        refine = {k for k, v in flags.items() if v == "refine" and k[0] < CODEC.depth}
        todo = list(refine)
        while todo:
            for _, relation, other in self.neighbours(todo.pop()):
                if relation == "coarser" and other not in refine:
                    refine.add(other)
                    todo.append(other)
        families = {}
        for level, x, y in self.leaves:
            s = 2 * self.side(level)
            if level > 1:
                families.setdefault((level - 1, x - x % s, y - y % s), []).append((level, x, y))
        gone = {}
        for parent, sons in families.items():
            if len(sons) == 4 and all(flags.get(k) == "coarsen" for k in sons):
                near = [(r, o) for k in sons for _, r, o in self.neighbours(k)]
                if not any(r == "finer" or (r == "same" and o in refine) for r, o in near):
                    gone[parent] = sons
        new = self.leaves - refine - {k for sons in gone.values() for k in sons} | set(gone)
        for level, x, y in refine:
            h = self.side(level) // 2
            new |= {(level + 1, x + a * h, y + b * h) for a in (0, 1) for b in (0, 1)}
        return Model(new)


def _frame(spark, leaves):
    rows = spark.createDataFrame([(level, x, y) for level, x, y in leaves], "level int, x long, y long")
    return rows.select(CODEC.encode([F.col("x"), F.col("y")], F.col("level")).alias("patch_id"), "level", "x", "y")


def _set(frame):
    return {(r.level, r.x, r.y) for r in frame.collect()}


def _key(leaf):
    level, x, y = leaf
    code = sum(((x >> i) & 1) << (2 * i) | ((y >> i) & 1) << (2 * i + 1) for i in range(CODEC.depth))
    return code << 6 | level


def test_random_passes_match_the_model(spark):
    rng = random.Random(7)
    model = Model({(2, x, y) for x in range(0, M, M // 4) for y in range(0, M, M // 4)})
    for _ in range(5):
        flags = {k: rng.choices(["refine", "coarsen", "stable"], [0.15, 0.6, 0.25])[0] for k in model.leaves}
        rows = spark.createDataFrame([(_key(k), v) for k, v in flags.items()], "patch_id long, status string")
        leaves = _frame(spark, model.leaves)
        near = {(r.patch_id, r.dir, r.relation, r.n_id) for r in tree.neighbors(leaves, CODEC).collect()}
        assert near == {(_key(k), d, rel, _key(o)) for k in model.leaves for d, rel, o in model.neighbours(k)}
        model = model.reconstruct(flags)
        got = _set(tree.reconstruct(leaves, rows, CODEC))
        assert got == model.leaves
        assert sum(4.0**-level for level, _, _ in got) == 1.0
        assert all(len(list(model.neighbours(k))) in range(4, 9) for k in got)


def test_uniform_root_and_text(spark):
    assert _set(tree.uniform(spark, CODEC, 2)) == {(2, x, y) for x in range(0, M, M // 4) for y in range(0, M, M // 4)}
    root = tree.root(spark, CODEC)
    assert _set(root) == {(0, 0, 0)}
    assert {r.relation for r in tree.neighbors(root, CODEC).collect()} == {"same"}  # its own neighbour
    assert tree.indent(root).first().line == "level 0 at 0,0"
    assert tree.same_topology(root, root) and not tree.same_topology(root, tree.uniform(spark, CODEC, 1))
    assert tree.lookup(root, [0]).count() == 1


def test_key_limits():
    with pytest.raises(ValueError):
        MortonCodec(3, 20)
    with pytest.raises(ValueError):
        PatchLayout((5, 8), 1)
    with pytest.raises(ValueError):
        PatchLayout((2, 2), 2)


def test_regridding_keeps_the_integral(spark, sf_dir):
    leaves, flags = S.flags_of_pass(spark, sf_dir, 0)
    refined, families = tree.plan_regrid(leaves, flags, S.CODEC, S.MIN_LEVEL)
    assert families.count() > 0 and refined.count() > 0
    cells = S.leaf_cells(leaves, S.grid(spark, sf_dir))
    new = intergrid.regrid_cells(cells, refined, families, S.CODEC, 8, ["u"])
    total = lambda c: c.agg(F.sum(F.col("u") * F.pow(F.lit(4.0), -F.col("level")))).first()[0]
    assert abs(total(cells) - total(new)) < 1e-6 * abs(total(cells))


def test_every_halo_cell_is_fed_once(spark, sf_dir):
    leaves = S.leaf_set(spark, sf_dir)
    for width in (1, 2):
        layout = PatchLayout((8, 8), width)
        sources = halo.halo_sources(leaves, S.CODEC, layout)
        per = sources.groupBy("patch_id", "dir", "j", "i", "relation").count()
        assert per.groupBy("patch_id").count().filter(F.col("count") != 4 * 8 * width).count() == 0
        assert {(r.relation, r["count"]) for r in per.select("relation", "count").distinct().collect()} == {("same", 1), ("coarser", 1), ("finer", 4)}


def test_constant_state_stays_constant(spark, sf_dir):
    from quadrille.functions.geometry import Geometry

    leaves = S.leaf_set(spark, sf_dir)
    cells = S.initialize(leaves, (8, 8), {"u": F.lit(3.0)}).select("patch_id", "level", "j", "i", "u")
    out = fvm.refined_step(cells, leaves, Advection(), 0.001, Geometry((1.0, 1.0), (8, 8), 7), S.CODEC, PatchLayout((8, 8), 1))
    assert out.count() == cells.count() and {r.u for r in out.select("u").distinct().collect()} == {3.0}


@pytest.mark.parametrize("rank, depth", [(2, 1), (2, 5), (2, 28), (3, 6), (3, 19)])
def test_keys_against_plain_arithmetic(spark, rank, depth):
    codec, draw = MortonCodec(rank, depth), random.Random(rank * depth)
    most = (1 << 57 - rank * depth) - 1
    rows = []
    for n in range(200):
        level = draw.randint(0, depth)
        side = 1 << (depth - level)
        place = [draw.choice([0, (1 << level) - 1, draw.randrange(1 << level)]) for _ in range(rank)]
        rows.append((n, level, min(most, draw.randrange(4)), *(p * side for p in place)))
    axes = tree.AXES[:rank]
    given = spark.createDataFrame(rows, "n long, level int, tree long, " + ", ".join(f"{a} long" for a in axes))
    keyed = given.withColumn("key", codec.encode([F.col(a) for a in axes], F.col("level"), F.col("tree")))
    steps = [(1, *[0] * (rank - 1)), (*[0] * (rank - 1), -1), (3, *[-2] * (rank - 1)), (0,) * rank, (-5, *[1] * (rank - 1))]
    found = {}
    for i, step in enumerate(steps):
        for periodic in (False, True):
            keyed = keyed.withColumn(f"m{i}{periodic:d}", codec.neighbor(F.col("key"), step, periodic))
            found[f"m{i}{periodic:d}"] = step, periodic
    back = keyed.withColumns(dict(zip((f"b{a}" for a in axes), codec.coords(F.col("key")), strict=True)))

    def plain(coords, level, number):
        code = sum(((c >> b) & 1) << (rank * b + a) for a, c in enumerate(coords) for b in range(depth))
        return (number << rank * depth | code) << 6 | level

    for r in back.withColumn("t", codec.tree(F.col("key"))).collect():
        own = [r[a] for a in axes]
        assert [r[f"b{a}"] for a in axes] == own and r.t == r.tree and r.key == plain(own, r.level, r.tree)
        for name, (step, periodic) in found.items():
            moved = [c + s * (1 << (depth - r.level)) for c, s in zip(own, step, strict=True)]
            inside = all(0 <= c < 1 << depth for c in moved)
            want = plain([c % (1 << depth) for c in moved], r.level, r.tree) if periodic or inside else None
            assert r[name] == want, (name, step, own, r.level)
