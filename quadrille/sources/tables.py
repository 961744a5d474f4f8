"""Grids, cells, points and leaf sets made by Spark from the driver's tables."""

from __future__ import annotations

import tempfile
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.morton import LEVEL_BITS, MortonCodec
from ..operators import tree

CODEC = MortonCodec(rank=2, depth=7)
CODEC3 = MortonCodec(rank=3, depth=7)
EXTENT = 64
#: Orders, or events, of a grid or tree: their number grows with the tables.
GROUP = 4096
#: Share of all points, as 1/n, above which a leaf is refined in each pass.
PASSES = (90, 200, 400)
START_LEVEL = 4
#: Level of the coarsest patches that coarsening may make.
MIN_LEVEL = 3
PATCH = 8


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a session on one machine (tests) may have none; it gets a local folder.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quadrille-"))
    return (folder or context.getCheckpointDir()).rstrip("/")


def initialize(leaves: DataFrame, sizes: tuple[int, int], values: dict[str, Column]) -> DataFrame:
    """One row a cell of every leaf (j along y, i along x) with the given columns."""
    j, i = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in sizes)
    return leaves.withColumn("j", j).withColumn("i", i).withColumns(values)


def square(spark: SparkSession, n: int = EXTENT) -> DataFrame:
    """All places of an n by n grid."""
    return spark.range(n * n).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))


def group(column: str) -> Column:
    """The grid or tree of a row."""
    return F.floor(F.col(column) / GROUP)


def places(sums: DataFrame, n: int, axes: tuple[str, ...]) -> DataFrame:
    """g and all places of an n by n [by n] grid, for every g of ``sums``.

    Spark takes an explode to be as large as what it explodes, so a join of these rows needs a hint against
    their broadcast.
    """
    out = sums.select("g").distinct()
    for a in axes:
        out = out.withColumn(a, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return out


def _sums(spark: SparkSession, sf_dir: str, n: int, columns: dict[str, str], *values: Column) -> DataFrame:
    """Every place of every grid of lineitem with its aggregates; null where no row falls."""
    sums = _held(spark, sf_dir, n, columns, *values)
    return places(sums, n, tuple(columns)).hint("merge").join(sums, ["g", *columns], "left")


def _held(spark: SparkSession, sf_dir: str, n: int, columns: dict[str, str], *values: Column) -> DataFrame:
    """The places that rows of lineitem fall on, with their aggregates."""
    at = [(F.col(c) % n).alias(a) for a, c in columns.items()]
    return read(spark, sf_dir, "lineitem").groupBy(group("l_orderkey").alias("g"), *at).agg(*values)


FLAT = {"x": "l_partkey", "y": "l_orderkey"}


def grid(spark: SparkSession, sf_dir: str, n: int = EXTENT) -> DataFrame:
    """g, x, y, u: quantities of lineitem summed on periodic grids, one for each group of orders."""
    sums = _sums(spark, sf_dir, n, FLAT, F.sum("l_quantity").alias("u"))
    return sums.select("g", "x", "y", F.coalesce("u", F.lit(0.0)).alias("u"))


def primitive_grid(spark: SparkSession, sf_dir: str, n: int = EXTENT) -> DataFrame:
    """g, x, y, rho, vx, vy, p: positive gas states from lineitem."""
    sums = _sums(
        spark, sf_dir, n, FLAT, F.sum("l_quantity").alias("u"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t")
    )
    got = lambda c: F.coalesce(c, F.lit(0.0))
    return sums.select(
        "g",
        "x",
        "y",
        (got("u") / 1000 + 1).alias("rho"),
        (got("d") * 0.7310585786300049).alias("vx"),
        (got("d") * -0.2689414213699951).alias("vy"),
        (got("t") + 1).alias("p"),
    )


def patches(spark: SparkSession, sf_dir: str, n: int = PATCH, level: int = 3) -> DataFrame:
    """patch_id, level, j, i, u: the grids cut into patches of n by n cells at one level, a tree each."""
    shift = CODEC.depth - level
    cut = lambda c: F.shiftleft(F.floor(F.col(c) / n), shift)
    return grid(spark, sf_dir, n << level).select(
        CODEC.encode([cut("x"), cut("y")], level, F.col("g")).alias("patch_id"),
        F.lit(level).alias("level"),
        (F.col("y") % n).cast("int").alias("j"),
        (F.col("x") % n).cast("int").alias("i"),
        "u",
    )


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corner and level for each lineitem: o, n, x, y, z on the grid of the level."""
    line = read(spark, sf_dir, "lineitem")
    level = F.col("l_linenumber")
    on = lambda c: F.call_function("shiftleft", F.call_function("shiftright", c % 128, 7 - level), 7 - level)
    return line.select(
        F.col("l_orderkey").alias("o"),
        level.cast("int").alias("n"),
        on(F.col("l_partkey")).alias("x"),
        on(F.col("l_suppkey")).alias("y"),
        on(F.col("l_orderkey")).alias("z"),
    ).filter("n between 1 and 7")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g, x, y of each event: its tree, and its place on the finest grid."""
    return read(spark, sf_dir, "events").select(
        group("event_id").alias("g"), (F.floor("value") % 128).alias("x"), (F.floor(F.col("value") * 3) % 128).alias("y")
    )


def locate(points: DataFrame, leaves: DataFrame, codec: MortonCodec = CODEC) -> DataFrame:
    """patch_id of the leaf that holds each point: one equi-join over the point's key at every level."""
    own = F.col("g") if "g" in points.columns else None
    finest = codec.encode([F.col(a) for a in tree.AXES[: codec.rank]], codec.depth, own)
    levels = F.sequence(F.lit(0), F.lit(codec.depth))
    up = points.select(finest.alias("__k")).groupBy("__k").agg(F.count("*").alias("n"))
    ancestors = up.select("n", "__k", F.explode(levels).alias("up"))
    code = F.shiftright("__k", 6)
    shift = F.col("up") * codec.rank
    key = F.call_function("shiftleft", F.call_function("shiftright", code, shift), shift + 6).bitwiseOR(
        (F.lit(codec.depth) - F.col("up")).cast("long")
    )
    return ancestors.select(key.alias("patch_id"), "n").join(leaves.select("patch_id"), "patch_id")


def point_flags(leaves: DataFrame, at: DataFrame, share: int, total: int | DataFrame, codec: MortonCodec = CODEC) -> DataFrame:
    """patch_id, status: refine where n * share > total, coarsen where n is a quarter of that at most.

    ``total`` is a number, or a table of g and total for each tree.
    """
    counts = locate(at, leaves, codec).groupBy("patch_id").agg(F.sum("n").alias("n"))
    n = F.coalesce("n", F.lit(0))
    if isinstance(total, DataFrame):
        leaves = leaves.withColumn("g", codec.tree(F.col("patch_id"))).join(total, "g", "left")
        total = F.coalesce("total", F.lit(0))
    status = (
        F.when((n * share > total) & (codec.level(F.col("patch_id")) < codec.depth), tree.REFINE)
        .when(n * share * 4 <= total, tree.COARSEN)
        .otherwise(tree.STABLE)
    )
    return leaves.join(counts, "patch_id", "left").select("patch_id", status.alias("status"))


def totals(at: DataFrame) -> DataFrame:
    """g, total: how many points each tree has; written, as every pass reads it."""
    return at.groupBy("g").agg(F.count("*").alias("total")).checkpoint()


def leaf_set(spark: SparkSession, sf_dir: str, passes: int = len(PASSES)) -> DataFrame:
    """Leaves after some passes of refinement and coarsening towards the events, a tree for each group of them."""
    at = points(spark, sf_dir)
    total = totals(at)
    leaves = tree.uniform(spark, CODEC, START_LEVEL, total.select("g"))
    for share in PASSES[:passes]:
        flags = point_flags(leaves, at, share, total).checkpoint()
        leaves = tree.reconstruct(leaves, flags, CODEC, MIN_LEVEL).checkpoint()
    return leaves


#: The octree: passes as above, from a uniform level, over the events with their users along z.
PASSES3, START_LEVEL3, MIN_LEVEL3, EXTENT3, PATCH3 = (60, 200), 2, 1, 32, 4


def points3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g, x, y, z of each event: its tree, and its place on the finest grid."""
    return read(spark, sf_dir, "events").select(
        group("event_id").alias("g"), (F.floor("value") % 128).alias("x"), (F.floor(F.col("value") * 3) % 128).alias("y"), (F.col("user_id") % 128).alias("z")
    )


def octree(spark: SparkSession, sf_dir: str, passes: int = len(PASSES3)) -> tuple[DataFrame, DataFrame]:
    """(leaves after some passes, flags of the last one on the leaves before it)."""
    at = points3(spark, sf_dir)
    total = totals(at)
    leaves, flags = tree.uniform(spark, CODEC3, START_LEVEL3, total.select("g")), None
    for share in PASSES3[:passes]:
        flags = point_flags(leaves, at, share, total, CODEC3).checkpoint()
        leaves = tree.reconstruct(leaves, flags, CODEC3, MIN_LEVEL3).checkpoint()
    return leaves, flags


FLAT3 = dict(zip(tree.AXES, ("l_partkey", "l_suppkey", "l_orderkey"), strict=True))


def grid3(spark: SparkSession, sf_dir: str, n: int = EXTENT3) -> DataFrame:
    """g, x, y, z, u: quantities of lineitem summed on periodic grids."""
    return _sums(spark, sf_dir, n, FLAT3, F.sum("l_quantity").alias("u")).select("g", *tree.AXES, F.coalesce("u", F.lit(0.0)).alias("u"))


def octree_cells(leaves: DataFrame, values: DataFrame, n: int = PATCH3, extent: int = EXTENT3) -> DataFrame:
    """patch_id, level, k, j, i, u: each cell takes the value of its tree's grid at its centre."""
    return cells_of(patch_values(leaves, values, CODEC3, n, extent), CODEC3, n)


def flags_of_pass(spark: SparkSession, sf_dir: str, number: int) -> tuple[DataFrame, DataFrame]:
    """(leaves before a pass, its flags)."""
    at = points(spark, sf_dir)
    leaves = leaf_set(spark, sf_dir, number)
    return leaves, point_flags(leaves, at, PASSES[number], totals(at)).checkpoint()


def leaf_cells(leaves: DataFrame, values: DataFrame, n: int = PATCH, extent: int = EXTENT) -> DataFrame:
    """patch_id, level, j, i, u: each cell takes the value of its tree's grid at its centre."""
    return cells_of(patch_values(leaves, values, CODEC, n, extent), CODEC, n)


def _blocks(values: DataFrame, codec: MortonCodec, n: int, extent: int) -> DataFrame:
    """block, held: for every patch that is no finer than the grid, (place, u) of those of its cells that have a value.

    A cell larger than a place takes the value at its centre, so each level holds fewer places than the next.
    """
    axes, finest = tree.AXES[: codec.rank], (extent // n).bit_length() - 1
    unit, level = codec.extent // extent, F.col("level")
    inside = reduce(Column.__and__, [(F.col(a) >= 0) & (F.col(a) < extent) for a in axes])
    levels = F.explode(F.array(*(F.lit(k) for k in range(finest + 1)))).alias("level")
    stride = F.call_function("shiftleft", F.lit(1), F.lit(finest) - level)
    rows = values.filter(inside).select("g", *axes, "u", levels).withColumn("stride", stride)
    rows = rows.filter(reduce(Column.__and__, [F.col(a) % F.col("stride") == F.shiftright("stride", 1) for a in axes]))
    corner = [F.floor(F.col(a) / (F.col("stride") * n)).cast("long") * (F.col("stride") * (n * unit)) for a in axes]
    at = F.lit(0)
    for a in reversed(axes):
        at = at * n + F.floor(F.col(a) / F.col("stride")) % n
    rows = rows.select(codec.encode(corner, level, F.col("g")).alias("block"), at.cast("int").alias("at"), "u")
    return rows.groupBy("block").agg(F.collect_list(F.struct("at", "u")).alias("held"))


def patch_values(
    leaves: DataFrame, values: DataFrame, codec: MortonCodec, n: int, extent: int, trees: DataFrame | None = None
) -> DataFrame:
    """patch_id, level, u: the values of a patch's cells, row-major, each that of its tree's grid at its centre.

    ``values`` are g, x, y[, z], u of an ``extent`` by ``extent`` grid; a cell without one is null, or 0.0 where
    its tree is in ``trees`` (g), and leaves of other trees have no row then.  A leaf meets one block of the grid, an array: no
    row a cell is shuffled.
    """
    if extent % n or (extent // n).bit_count() != 1 or extent > codec.extent:
        raise ValueError("the grid must be a power of two of patches a side, no finer than the finest cells")
    axes, size, finest = tree.AXES[: codec.rank], n**codec.rank, (extent // n).bit_length() - 1
    key, level = F.col("patch_id"), codec.level(F.col("patch_id"))
    own = F.least(level, F.lit(finest))
    shift = (F.lit(codec.depth) - own) * codec.rank + LEVEL_BITS
    block = F.call_function("shiftleft", F.call_function("shiftright", key, shift), shift).bitwiseOR(own.cast("long"))
    rows = leaves.select("patch_id", level.alias("level"), block.alias("block"))
    if trees is not None:
        named = trees.select(F.col("g").alias("__g"))
        rows = rows.join(named, codec.tree(key) == F.col("__g"), "left_semi")
    filled = F.col("held") if trees is None else F.filter("held", lambda h: h["u"].isNotNull())
    found = _blocks(values, codec, n, extent).select("block", F.map_from_entries(filled).alias("__m"))
    none = F.lit(None).cast("double") if trees is None else F.lit(0.0)
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda q: F.coalesce(F.element_at("__m", q), none))
    met = rows.join(found.select("block", dense.alias("__v")), "block", "left")
    # Where the leaf's cells lie in its block, along each axis.
    side, up = codec.side(F.col("level")), codec.depth + 1 - F.least(F.col("level"), F.lit(finest))
    off = [own - base for own, base in zip(codec.coords(key), codec.coords(F.col("block")), strict=True)]
    at = {
        f"__{a}{k}": F.call_function("shiftright", o * (2 * n) + side * (2 * k + 1), up).cast("int")
        for a, o in zip(axes, off, strict=True)
        for k in range(n)
    }
    met = met.select("patch_id", "level", "__v", *(c.alias(name) for name, c in at.items()))
    cells = []
    for place in product(range(n), repeat=codec.rank):
        index = F.lit(0)
        for a, k in zip(reversed(axes), place, strict=True):
            index = index * n + F.col(f"__{a}{k}")
        cells.append(F.coalesce(F.get("__v", index), none))
    return met.select("patch_id", "level", F.array(*cells).alias("u"))


def cells_of(patches: DataFrame, codec: MortonCodec, n: int) -> DataFrame:
    """patch_id, level, [k,] j, i, u: a row for each cell of ``patch_values`` that has a value.

    The explode is an outer one: for an inner one Spark infers a filter on the size of the array, and with a join above it then plans
    for minutes with all variants of the places that the array's 64 values are made of.
    """
    names = tree.INDICES[-codec.rank :]
    at = [F.floor(F.col("__q") / n ** (codec.rank - 1 - d)).cast("int") % n for d in range(codec.rank)]
    rows = patches.select("patch_id", "level", F.posexplode_outer("u").alias("__q", "u")).filter("u is not null")
    return rows.select("patch_id", "level", *(c.alias(m) for c, m in zip(at, names, strict=True)), "u")


def leaf_patches(spark: SparkSession, sf_dir: str, leaves: DataFrame) -> DataFrame:
    """patch_id, level, u: the cells of a quadtree's leaves, 8 by 8 values of ``grid``."""
    held = _held(spark, sf_dir, EXTENT, FLAT, F.sum("l_quantity").alias("u"))
    return patch_values(leaves, held, CODEC, PATCH, EXTENT, trees(spark, sf_dir))


def octree_patches(spark: SparkSession, sf_dir: str, leaves: DataFrame) -> DataFrame:
    """patch_id, level, u: the cells of an octree's leaves, 4 by 4 by 4 values of ``grid3``."""
    held = _held(spark, sf_dir, EXTENT3, FLAT3, F.sum("l_quantity").alias("u"))
    return patch_values(leaves, held, CODEC3, PATCH3, EXTENT3, trees(spark, sf_dir))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g of every grid."""
    return read(spark, sf_dir, "lineitem").select(group("l_orderkey").alias("g")).distinct()
