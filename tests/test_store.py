"""Stored leaves, neighbours and patches: maintained by deltas, joined without exchanges, rewritten by zones."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from quadrille.functions.morton import MortonCodec
from quadrille.operators import halo, tree
from quadrille.operators.layout import PatchLayout
from quadrille.operators.store import Store


def _files(store: Store, table: str) -> dict[str, set[str]]:
    """Names of a table's files by zone."""
    top = f"{store.folder.removeprefix('file:')}/{table}"
    return {d: {f for f in os.listdir(f"{top}/{d}") if f.endswith(".parquet")} for d in os.listdir(top) if d.startswith("zone=")}


def _rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize(("rank", "level", "share"), [(2, 3, 0.2), (3, 2, 0.1)])
def test_links_follow_random_passes(spark, rank, level, share):
    """After each pass of refinement and coarsening the stored tables equal those worked out anew."""
    codec, rng = MortonCodec(rank, 5), random.Random(rank)
    store = Store(spark, codec, 1, 2)
    leaves = tree.uniform(spark, codec, level, spark.range(2))
    store.create(leaves)
    for number in range(3):
        keys = [r.patch_id for r in store.leaves().collect()]
        status = [rng.choices(["refine", "coarsen", "stable"], [share, 0.6, 0.2])[0] for _ in keys]
        if number == 1:  # a pass in which whole families coarsen
            status = ["coarsen"] * len(keys)
        flags = spark.createDataFrame(list(zip(keys, status, strict=True)), "patch_id long, status string")
        before = store.leaves()
        want = tree.reconstruct(before, flags, codec, 2)
        want_rows = _rows(want.select("patch_id"))
        store.advance(*tree.plan_regrid(before, flags, codec, 2, store.links()))
        assert _rows(store.read("leaves").select("patch_id")) == want_rows
        names = ["patch_id", "dir", "relation", "n_id"]
        assert _rows(store.links()) == _rows(tree.neighbors(store.leaves(), codec).select(*names))
    store.drop()
    assert not os.path.exists(store.folder.removeprefix("file:"))


def test_a_pass_reads_and_rewrites_its_zones_alone(spark):
    codec = MortonCodec(2, 7)
    store = Store(spark, codec, 3, 2)  # 64 zones
    store.create(tree.uniform(spark, codec, 5))
    files = {t: _files(store, t) for t in ("leaves", "links")}
    inner = codec.encode([F.lit(4 * 5), F.lit(4 * 6)], 5)  # inside a zone, not at its edge
    refined = spark.range(1).select(inner.alias("patch_id"))
    none = refined.filter("false")
    change = store.advance(refined, none)
    assert (change.leaf_zones, change.link_zones, change.leaves_read, change.links_read) == (1, 1, 16, 64)
    after = {t: _files(store, t) for t in ("leaves", "links")}
    for table, zones in files.items():
        assert sum(after[table][z] != names for z, names in zones.items()) == 1
    assert store.leaves().count() == 1024 + 3
    # At a zone's edge the links of the zone beyond change too, its leaves do not.
    edge = spark.range(1).select(codec.encode([F.lit(16), F.lit(4 * 6)], 5).alias("patch_id"))
    change = store.advance(edge, none)
    assert (change.leaf_zones, change.link_zones) == (1, 2) and change.leaves_read <= 40
    assert store.advance(none, none).links_read == 0
    assert _rows(store.links()) == _rows(tree.neighbors(store.leaves(), codec))


def _refined(spark, codec, level):
    """A leaf set with all three relations."""
    leaves = tree.uniform(spark, codec, level)
    picked = leaves.filter("x = 0 and y = 0").select("patch_id").checkpoint()
    return tree.regrid_keys(leaves, picked, picked.filter("false"), codec).checkpoint()


@pytest.mark.parametrize(("rank", "level", "size", "width"), [(2, 2, 4, 1), (2, 2, 4, 2), (3, 1, 4, 1)])
def test_bucketed_halo_needs_no_exchange(spark, rank, level, size, width):
    codec, layout = MortonCodec(rank, 4), PatchLayout((size,) * rank, width)
    leaves = _refined(spark, codec, level)
    cells = leaves
    for m in tree.INDICES[-rank:]:
        cells = cells.withColumn(m, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    names = tree.INDICES[-rank:]
    cells = cells.select("patch_id", "level", *names, (F.pmod(F.xxhash64("patch_id", *names), F.lit(1000)) / 8).alias("u")).checkpoint()
    store = Store(spark, codec, 1, 3)
    store.create(leaves)
    store.save("patches", halo.patch_rows(cells, layout, ["u"]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = halo.patch_halos(store.links(), store.read("patches"), codec, layout, ["u"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        want = halo.halo_exchange(cells, leaves, codec, layout, ["u"])
        order = ["patch_id", "level", "dir", *names, "relation", "u"]
        assert {r.relation for r in found.select("relation").distinct().collect()} == {"same", "coarser", "finer"}
        assert _rows(found.select(*order)) == _rows(want.select(*order))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        store.drop()


def test_walls_and_own_operators(spark):
    """A wall that holds a value, and a finer side that takes the largest source."""
    codec, layout = MortonCodec(2, 3), PatchLayout((2, 2), 1)
    leaves = _refined(spark, codec, 2)
    cells = leaves.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    cells = cells.select("patch_id", "level", "j", "i", (F.col("x") * 8 + F.col("y") + F.col("j") * 0.25 + F.col("i") * 0.5).alias("u"))
    using = halo.HaloOperators(boundary=lambda v, f, a: F.lit(-7.0), finer=lambda v, f, a: F.array_max(v))
    links = tree.neighbors(leaves, codec, periodic=False)
    got = halo.patch_halos(links, halo.patch_rows(cells, layout, ["u"]), codec, layout, ["u"], using).cache()
    walls = got.filter("relation = 'boundary'")
    assert {r.u for r in walls.collect()} == {-7.0}
    outer = leaves.filter("x = 0 or y = 0 or x + shiftleft(1L, 3 - level) = 8 or y + shiftleft(1L, 3 - level) = 8")
    assert walls.select("patch_id").distinct().count() == outer.count()
    want = halo.halo_exchange(cells, leaves, codec, layout, ["u"], links.filter("relation <> 'boundary'"), F.max)
    names = ["patch_id", "dir", "j", "i", "relation", "u"]
    assert _rows(got.filter("relation <> 'boundary'").select(*names)) == _rows(want.select(*names))
