"""Lookups in stored tables against plain filters; what the scans open and read is counted."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quadrille.functions.morton import MortonCodec
from quadrille.operators import lookup, tree
from quadrille.operators.store import Store


def _scanned(frame) -> dict[str, int]:
    """Rows of a frame, files its scan opened and rows the scan gave."""
    rows = frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.size() == 1
    scan = leaves.apply(0)
    files = {f.filePath().toString() for part in scan.inputRDD().partitions() for f in part.files()}
    return {"rows": len(rows), "files": len(files), "read": scan.metrics().apply("numOutputRows").value()}


def _store(spark, rank=2, depth=7, level=5, zone=3, group=None):
    codec = MortonCodec(rank, depth)
    store = Store(spark, codec, zone, 2)
    leaves = tree.uniform(spark, codec, level, spark.range(2))
    store.create(leaves)
    store.save("patches", leaves.select("patch_id", F.col("patch_id").cast("double").alias("u")), group)
    return store


def test_plain_keys_are_those_of_the_columns(spark):
    for rank, depth in ((2, 7), (3, 5)):
        codec, rng = MortonCodec(rank, depth), random.Random(rank)
        rows = [(rng.randrange(9), *(rng.randrange(codec.extent) for _ in range(rank)), rng.randrange(depth + 1)) for _ in range(40)]
        names = tree.AXES[:rank]
        frame = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ("t", *names, "level")))
        got = frame.select(codec.encode([F.col(a) for a in names], F.col("level"), F.col("t")).alias("k"), "t", *names, "level").collect()
        assert all(r.k == codec.key([r[a] for a in names], r.level, r.t) for r in got)


@pytest.mark.parametrize("rank", [2, 3])
def test_cells_cover_boxes(rank):
    codec, rng = MortonCodec(rank, 4), random.Random(rank)
    for _ in range(60):
        low = [rng.randrange(16) for _ in range(rank)]
        high = [rng.randrange(a + 1, 17) for a in low]
        for most in (1, 7, 32, 10**6):
            cells = lookup.cells_of_box(codec, low, high, most)
            assert 0 < len(cells) <= most
            held = [p for level, c in cells for p in _places(c, 16 >> level)]
            assert len(held) == len(set(held))
            box = set(_places_of(low, high))
            assert box <= set(held)
            if most == 10**6:
                assert box == set(held)


def _places_of(low, high):
    out = [()]
    for a, b in zip(low, high, strict=True):
        out = [(*p, v) for p in out for v in range(a, b)]
    return out


def _places(corner, side):
    return _places_of(corner, [a + side for a in corner])


def test_keys_open_their_bucket_of_their_zone(spark):
    store = _store(spark)  # 128 zones of 16 patches in two buckets
    codec = store.codec
    one = codec.key((4 * 9, 4 * 20), 5, 1)
    seen = _scanned(lookup.by_keys(store, "patches", [one, one, None]))
    assert (seen["rows"], seen["files"]) == (1, 1) and seen["read"] <= 16
    absent = codec.key((4 * 9, 4 * 20), 6, 1)
    assert _scanned(lookup.by_keys(store, "patches", [absent]))["rows"] == 0
    assert lookup.by_keys(store, "patches", []).collect() == []
    many = [codec.key((4 * k, 0), 5, 0) for k in range(8)]
    seen = _scanned(lookup.by_keys(store, "patches", many))
    assert seen["rows"] == 8 and seen["files"] <= 4  # two zones, two buckets each
    store.drop()


def test_keys_skip_row_groups(spark):
    codec = MortonCodec(2, 10)
    store = Store(spark, codec, 0, 1)  # one zone, one file
    leaves = tree.uniform(spark, codec, 9).select("patch_id", F.rand(1).alias("u"))
    store.save("patches", leaves, 1 << 18)
    every = store.read("patches")
    seen = _scanned(lookup.by_keys(store, "patches", [codec.key((2 * 300, 2 * 77), 9)]))
    assert seen["rows"] == 1 and seen["files"] == 1
    assert seen["read"] * 4 < every.count() == 1 << 18
    box = _scanned(lookup.by_box(store, "patches", (600, 100), (612, 116)))
    assert box["rows"] == 6 * 8 and box["read"] * 4 < 1 << 18
    store.drop()


@pytest.mark.parametrize(("rank", "depth", "level"), [(2, 7, 4), (3, 5, 3)])
def test_boxes_and_places_on_leaves_of_many_levels(spark, rank, depth, level):
    codec, rng = MortonCodec(rank, depth), random.Random(rank)
    leaves = tree.uniform(spark, codec, level, spark.range(2))
    for _ in range(2):
        keys = [r.patch_id for r in leaves.collect()]
        flags = [(k, rng.choices(["refine", "coarsen", "stable"], [0.1, 0.7, 0.2])[0]) for k in keys]
        leaves = tree.reconstruct(leaves, spark.createDataFrame(flags, "patch_id long, status string"), codec, 1).checkpoint()
    store = Store(spark, codec, 1, 2)
    store.create(leaves)
    axes = tree.AXES[:rank]
    own = [(r.patch_id, r.patch_id >> (rank * depth + 6), tuple(r[a] for a in axes), codec.extent >> r.level) for r in leaves.collect()]
    for _ in range(4):
        low = [rng.randrange(codec.extent) for _ in axes]
        high = [rng.randrange(a, codec.extent) + 1 for a in low]
        t = rng.randrange(2)
        want = {k for k, g, c, s in own if g == t and all(a < h and a + s > b for a, b, h in zip(c, low, high, strict=True))}
        got = [r.patch_id for r in lookup.by_box(store, "leaves", low, high, t).collect()]
        assert len(got) == len(want) and set(got) == want
    assert lookup.by_box(store, "leaves", [3] * rank, [3] * rank).collect() == []
    hot = tuple(rng.randrange(codec.extent) for _ in axes)
    rows = [(n, rng.randrange(2), *(hot if n % 3 == 0 else (rng.randrange(codec.extent) for _ in axes))) for n in range(90)]
    rows += [(90, 0, None, *([0] * (rank - 1))), (91, 7, *([0] * rank))]
    places = spark.createDataFrame(rows, "n long, g long, " + ", ".join(f"{a} long" for a in axes))
    got = {r.n: r.patch_id for r in lookup.by_places(store, "leaves", places, F.col("g")).collect()}
    want = {r[0]: k for r in rows[:90] for k, g, c, s in own if g == r[1] and all(a <= p < a + s for a, p in zip(c, r[2:], strict=True))}
    assert len(want) == 90 and got == want
    store.drop()


def test_places_leave_the_table_in_its_buckets(spark):
    store = _store(spark)
    places = spark.range(1000).select("id", (F.col("id") % 128).alias("x"), (F.col("id") * 7 % 128).alias("y"))
    conf, before = spark.conf, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lookup.by_places(store, "patches", places)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 1000
    finally:
        conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = plan.index("FileScan parquet")
    # Between the join and the table there is no exchange: the line above the scan's own operators is the join's other side.
    above = plan[:scan].splitlines()[-4:]
    assert not any("Exchange" in line for line in above)
    store.drop()
