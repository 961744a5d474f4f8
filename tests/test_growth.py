"""What keeps work in proportion at size: joins, shuffles, files and buckets, checked on small inputs."""

import os
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from quadrille.functions.geometry import Geometry
from quadrille.functions.morton import MortonCodec
from quadrille.operators import dg, fvm, halo, intergrid, tree
from quadrille.operators.layout import PatchLayout
from quadrille.operators.store import Store
from quadrille.plans import queries, stored
from quadrille.sinks import meshes, vtk
from quadrille.sources import tables as S


def _plan(frame) -> str:
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_all_places_of_the_grids_are_not_broadcast(spark, sf_dir):
    assert "Broadcast" not in _plan(S.grid(spark, sf_dir).filter("u > 0"))


def test_dumps_are_not_broadcast(spark, sf_dir):
    plan = _plan(queries.QUERIES["dump_offsets"](spark, sf_dir))
    assert re.search(r"SortMergeJoin \[timestep#\d+L?, patch#", plan) and not re.search(r"BroadcastHashJoin \[timestep#\d+L?, patch#", plan)


@pytest.mark.parametrize("rank, n, extent", [(2, 8, 64), (3, 4, 32)])
def test_values_of_patches_at_every_level(spark, rank, n, extent):
    codec, axes = MortonCodec(rank, 7), "xyz"[:rank]
    corners = [(level, g, tuple(((k * 37 + 11 * d) % (1 << level)) << (7 - level) for d in range(rank))) for level in range(8) for g in (0, 2) for k in range(3)]
    keys = sorted({(codec.key(c, level, g), level, g, c) for level, g, c in corners})
    held = {(g, *p): float(sum((i + 2) * v for i, v in enumerate(p)) + g) for g in (0, 2) for p in product(range(0, extent, 3), repeat=rank)}
    values = spark.createDataFrame([(g, *p, u) for (g, *p), u in held.items()], "g long, " + ", ".join(f"{a} long" for a in axes) + ", u double")
    leaves = spark.createDataFrame([(k,) for k, *_ in keys], "patch_id long")

    def expected(level, g, corner, none):
        side, out = 128 >> level, []
        for index in product(range(n), repeat=rank):  # the first is along the last axis
            at = tuple((corner[d] * 2 * n + (2 * index[rank - 1 - d] + 1) * side) * extent // (2 * n * 128) for d in range(rank))
            out.append(held.get((g, *at), none))
        return out

    got = {r.patch_id: r.u for r in S.patch_values(leaves, values, codec, n, extent).collect()}
    assert got == {k: expected(level, g, c, None) for k, level, g, c in keys}
    of = spark.createDataFrame([(2,), (7,)], "g long")
    got = {r.patch_id: r.u for r in S.patch_values(leaves, values, codec, n, extent, of).collect()}
    assert got == {k: expected(level, g, c, 0.0) for k, level, g, c in keys if g == 2}


def test_patches_to_parents_and_children_without_a_shuffle(spark):
    codec, n = MortonCodec(3, 7), 4
    leaves = tree.uniform(spark, codec, 1)
    values = F.transform(F.sequence(F.lit(0), F.lit(n**3 - 1)), lambda q: (q * q % 23 + F.col("x") + F.col("z") * 2).cast("double"))
    patches = leaves.select("patch_id", "level", values.alias("u"))
    cells = S.cells_of(patches, codec, n)
    up = intergrid.restrict_patches(patches, codec, n, {"u": ("u", lambda v: sum(v[1:], v[0]) / 8)})
    down = intergrid.prolong_patches(patches, codec, n, ["u"], lambda u, at: u + at[0] - at[2] * 0.5)
    for got, want in ((up, intergrid.restrict(cells, codec, n, ["u"])), (down, intergrid.prolong(cells, codec, n, ["u"], lambda u, at: u + at[0] - at[2] * 0.5))):
        assert "Exchange" not in _plan(got)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_stores_of_many_trees_have_more_buckets_not_more_zones(spark):
    small, large = (stored.new_store(spark, S.CODEC, n) for n in (3, 1465))
    assert (small.zone_level, small.buckets) == (1, 4)
    assert large.buckets >= 45 and large.zone_level < 0
    assert len({large.zone_of(S.CODEC.key((0, 0), 3, g)) for g in range(1465)}) <= stored.MOST_ZONES


def test_zones_of_several_trees(spark):
    from quadrille.operators import lookup

    codec = MortonCodec(2, 4)
    trees = spark.range(9).withColumnRenamed("id", "g")
    store = Store(spark, codec, -1, 2)
    leaves = tree.uniform(spark, codec, 2, trees)
    store.create(leaves)
    assert store.read("leaves").select("zone").distinct().count() == 3
    assert sorted(map(tuple, store.links().collect())) == sorted(map(tuple, tree.neighbors(leaves, codec).collect()))
    places = spark.createDataFrame([(g, 5, 9) for g in range(9)], "g long, x long, y long")
    got = {r.g: r.patch_id for r in lookup.by_places(store, "leaves", places, F.col("g")).collect()}
    assert got == {g: codec.key((4, 8), 2, g) for g in range(9)}
    assert [r.patch_id for r in lookup.by_box(store, "leaves", (5, 9), (6, 10), 6).collect()] == [codec.key((4, 8), 2, 6)]
    store.advance(leaves.filter(F.col("patch_id") == codec.key((4, 8), 2, 6)).select("patch_id"), leaves.filter("false").select("patch_id"))
    assert store.read("leaves").count() == 9 * 16 + 3


def test_cells_of_a_file_share_their_corners(spark, tmp_path):
    folder = str(tmp_path)
    at = [(F.floor(F.col("id") / 16**d) % 16).cast("double") for d in range(3)]
    cells = spark.range(0, 4096, 1, 1).select(
        F.col("id").cast("int").alias("n"), *(c.alias(f"{a}0") for c, a in zip(at, "xyz", strict=True)), *(F.lit(1.0).alias(f"d{a}") for a in "xyz")
    )
    meshes.write(cells, folder, share_corners=True)
    [name] = [f for f in os.listdir(folder) if f.endswith(".vtk")]
    with open(f"{folder}/{name}", "rb") as file:
        assert b"POINTS 4913 double" in file.read(200)  # 17 to the power of 3; 32768 where each cell has its own
    got = {(r.n, r.x0, r.y0, r.z0, r.x1, r.y1, r.z1) for r in meshes.read(spark, folder).collect()}
    assert got == {(k, *(float(v) for v in p), *(v + 1.0 for v in p)) for k in range(4096) for p in [(k % 16, k // 16 % 16, k // 256)]}


def test_a_dg_stage_sends_cells_not_faces(spark):
    cells = spark.range(64 * 64).select((F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"), F.array(*(F.rand(k) for k in range(4))).alias("u"))
    plan = _plan(dg.rhs(cells, dg.Config(order=2), dg.LinearAdvection((1.0, 1.0))))
    assert "Aggregate" not in plan and "Window" in plan


class Probe:
    """Two fields that need the states on both sides of every face."""

    fields = ("u", "v")

    def flux(self, left, right, axis):
        return {"u": left["u"] * 2.0 - right["v"] * float(axis + 1), "v": left["v"] + right["u"] * 3.0}


@pytest.mark.parametrize("periodic", [True, False])
def test_a_refined_step_of_patches_equals_one_of_cells(spark, periodic):
    codec, n = MortonCodec(2, 5), 4
    layout, unit = PatchLayout((n, n), 1), Geometry((1.0, 1.0), (n, n), 5)
    trees = spark.range(2).withColumnRenamed("id", "g")
    leaves = tree.uniform(spark, codec, 2, trees)
    for corner, level in ((0, 2), (8, 2), (8, 3)):
        wanted = spark.createDataFrame([(codec.key((corner, corner), level, g),) for g in (0, 1)], "patch_id long")
        refined = tree.balance_refinement(wanted, leaves, codec)
        leaves = tree.regrid_keys(leaves, refined, wanted.filter("false"), codec).checkpoint()
    cells = S.initialize(leaves, (n, n), {"u": F.rand(3), "v": F.rand(4)}).select("patch_id", "level", "j", "i", "u", "v").checkpoint()
    nbr = tree.neighbors(leaves, codec, periodic=periodic).checkpoint()
    assert {r.relation for r in nbr.select("relation").distinct().collect()} == {"same", "coarser", "finer", *(() if periodic else ("boundary",))}
    pad = {(r.patch_id, r.j, r.i): (r.u, r.v) for r in halo.padded(cells, leaves, codec, layout, ["u", "v"], nbr).collect()}
    step = fvm.refined_step(cells, leaves, Probe(), 0.01, unit, codec, layout, nbr)
    got = {(r.patch_id, r.j, r.i): (r.u, r.v) for r in step.collect()}
    assert len(got) == step.count() == cells.count()
    flux = lambda a, b, axis: (2 * a[0] - b[1] * (axis + 1), a[1] + 3 * b[0])
    for (key, j, i), found in got.items():
        want, here = list(pad[key, j, i]), pad[key, j, i]
        for axis, (dj, di) in enumerate(((0, 1), (1, 0))):
            into, out = flux(pad[key, j - dj, i - di], here, axis), flux(here, pad[key, j + dj, i + di], axis)
            scale = 0.01 * n * 2 ** (key & 63)
            want = [w - (o - m) * scale for w, o, m in zip(want, out, into, strict=True)]
        assert found == pytest.approx(want, abs=1e-11)


def test_a_refined_step_sends_faces_not_cells(spark, sf_dir):
    plan = _plan(queries.QUERIES["fvm_refined_step"](spark, sf_dir)).split("Initial Plan")[0]
    assert "Window" not in plan and "Exchange" not in plan[: plan.index("Generate explode")]


def test_cells_of_patches_infer_no_filter_on_their_arrays(spark, sf_dir):
    leaves = tree.uniform(spark, S.CODEC, 2)
    patches = S.leaf_patches(spark, sf_dir, leaves)
    plan = S.cells_of(patches, S.CODEC, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "size(array(" not in plan


@pytest.mark.parametrize("rank, n", [(2, 8), (3, 4)])
def test_regridding_of_patches_equals_that_of_cells(spark, rank, n):
    codec, trees = MortonCodec(rank, 7), spark.range(2).withColumnRenamed("id", "g")
    leaves = tree.uniform(spark, codec, 2, trees)
    key = F.col("patch_id")
    families = tree.uniform(spark, codec, 1, trees).filter(codec.offset_of(key) == 1).select("patch_id")
    refined = leaves.filter((codec.offset_of(codec.parent(key)) == 2) & (codec.offset_of(key) > 0)).select("patch_id")
    values = lambda k: F.transform(F.sequence(F.lit(0), F.lit(n**rank - 1)), lambda q: (q * q % 23 + k * F.col("x") + codec.tree(key) * 5).cast("double"))
    patches = leaves.select("patch_id", "level", values(1).alias("u"), values(3).alias("v")).checkpoint()
    zipped = patches.select("patch_id", "level", F.posexplode(F.arrays_zip("u", "v")).alias("q", "c"))
    index = [(F.floor(F.col("q") / n ** (rank - 1 - d)).cast("int") % n).alias(m) for d, m in enumerate(tree.INDICES[-rank:])]
    cells = zipped.select("patch_id", "level", *index, "c.u", "c.v")
    slope = lambda u, at: u + at[0] * 2 - at[-1] * 0.5
    for most, many, spread in ((F.avg, None, None), (F.max, lambda v: F.greatest(*v), slope)):
        got = intergrid.regrid_patches(
            patches, refined, families, codec, n, ["u", "v"], **({"combine": many} if many else {}), **({"spread": spread} if spread else {})
        )
        want = intergrid.regrid_cells(cells, refined, families, codec, n, ["u", "v"], combine=most, **({"spread": spread} if spread else {}))
        assert got.columns == want.columns
        rows = [sorted(map(tuple, f.collect())) for f in (got, want)]
        assert rows[0] == rows[1] and {r[1] for r in rows[0]} == {1, 2, 3}


def test_regridding_of_patches_sends_no_cells(spark, sf_dir):
    plan = _plan(queries.QUERIES["regrid_cells"](spark, sf_dir)).split("Initial Plan")[0]
    assert "Generate inline" in plan and "Exchange" not in plan[: plan.index("Generate inline")]


def _random_cells(spark, extent, order, components):
    """Two grids; positive where components need it."""
    rows = spark.range(2 * extent * extent).select(
        F.floor(F.col("id") / extent**2).alias("g"), (F.col("id") % extent).alias("x"), (F.floor(F.col("id") / extent) % extent).alias("y")
    )
    add = {"rho": 1.0, "e": 2.5}
    nodes = F.sequence(F.lit(0), F.lit(order**2 - 1))
    value = lambda c: F.transform(nodes, lambda q: F.pmod(F.hash(q, "g", "x", "y", F.lit(c)), F.lit(1000)) / 4000.0 + add.get(c, 0.0))
    return rows.select("g", "x", "y", *(value(c).alias(c) for c in components))


@pytest.mark.parametrize("patch", [64, 3])
@pytest.mark.parametrize(
    "extent, order, equation, components, integrator",
    [
        (9, 3, dg.NodalEuler(), dg.NodalEuler.components, "ssprk3"),
        (10, 2, dg.LinearAdvection((1.0, -0.5)), ("u",), "ssprk2"),
        (9, 1, dg.LinearAdvection((-1.0, 0.5)), ("u",), "euler"),
    ],
)
def test_a_dg_step_of_blocks_equals_one_of_cells(spark, monkeypatch, patch, extent, order, equation, components, integrator):
    """A grid that is one block, and one of several blocks whose last are narrower."""
    monkeypatch.setattr(dg, "PATCH", patch)
    config = dg.Config(order=order, extent=extent, components=tuple(components))
    cells = _random_cells(spark, extent, order, components)
    got, want = ({(r.g, r.x, r.y): [r[c] for c in components] for r in f(cells, config, equation, 0.001, integrator, ("g",)).collect()} for f in (dg.advance, dg.advance_cells))
    assert len(got) == 2 * extent**2 and got.keys() == want.keys()
    for k, found in got.items():
        for a, b in zip(found, want[k], strict=True):
            assert a == pytest.approx(b, abs=1e-13)


def test_all_stages_of_a_dg_step_take_one_shuffle(spark):
    cells = _random_cells(spark, 64, 2, ("u",))
    plan = _plan(dg.advance(cells, dg.Config(order=2), dg.LinearAdvection((1.0, 1.0)), 0.001, "ssprk3", ("g",))).split("Initial Plan")[0]
    assert "Window" not in plan and len(re.findall(r"\bExchange\b", plan)) == 1


def test_a_dg_step_of_wrong_arrays_fails(spark):
    cells = _random_cells(spark, 4, 3, ("u",))
    with pytest.raises(Exception, match="arrays of 4 numbers"):
        dg.advance(cells, dg.Config(order=2, extent=4), dg.LinearAdvection((1.0, 1.0)), 0.001, "euler").collect()


def test_packed_files_hold_the_same_cells_in_a_fraction_of_the_bytes(spark, tmp_path):
    leaves = tree.uniform(spark, S.CODEC3, 2)
    patches = leaves.coalesce(1).select("patch_id", "level", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda q: (q % 7).cast("double")).alias("u"))
    unit = Geometry((1.0, 1.0, 1.0), (4, 4, 4), S.CODEC3.depth)
    cells = vtk.with_own_boxes(S.cells_of(tree.sort_by_key(patches, 1), S.CODEC3, 4), S.CODEC3, unit)
    found, size = {}, {}
    for kind in ("none", "zstd", "gzip"):
        folder = str(tmp_path / kind)
        meshes.write(cells, folder, share_corners=True, compression=kind)
        names = [f for f in os.listdir(folder) if f.startswith("part-")]
        assert names and all(f.endswith(meshes.ENDINGS[kind]) for f in names)
        size[kind] = sum(os.path.getsize(f"{folder}/{f}") for f in names)
        found[kind] = sorted(map(tuple, meshes.read(spark, folder).drop("file").collect()))
        whole = found[kind]
        box = meshes.read(spark, folder, (0.1, 0.1, 0.1, 0.3, 0.2, 0.2)).drop("file").collect()
        assert 0 < len(box) < len(whole) == 4096 and set(map(tuple, box)) <= set(whole)
        for f in os.listdir(folder):  # what is left is read file by file
            if not f.startswith("part-"):
                os.remove(f"{folder}/{f}")
        assert sorted(map(tuple, meshes.read(spark, folder).select(*meshes.read(spark, folder).drop("file").columns).collect()))
    assert found["none"] == found["zstd"] == found["gzip"]
    assert size["zstd"] * 5 < size["none"] and size["gzip"] * 5 < size["none"]
    with pytest.raises(Exception, match="compression is one of"):
        meshes.write(cells, str(tmp_path / "other"), compression="best")


@pytest.mark.parametrize("name", ["mesh_voxels", "mesh_box", "mesh_cells", "mesh_nodes"])
def test_meshes_of_the_queries_are_packed(spark, sf_dir, name, monkeypatch):
    written, write = [], meshes.write
    monkeypatch.setattr(meshes, "write", lambda cells, folder, *a, **k: (written.append(folder), write(cells, folder, *a, **k)))
    queries.QUERIES[name](spark, sf_dir)
    [folder] = written
    names = [f for f in os.listdir(folder.removeprefix("file:")) if f.startswith("part-")]
    assert names and all(f.endswith(".vtk.zst") for f in names)
