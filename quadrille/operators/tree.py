"""Leaf sets of a periodic quadtree or octree, kept as tables of Morton keys.

A leaf set is ``patch_id, level, x, y[, z]``, of one tree or of many: keys carry their tree.  Neighbours are not stored: they follow from the set by
three equi-joins.  All functions take and return DataFrames; broadcasts are left to Spark, which
checks sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.morton import MortonCodec

AXES = ("x", "y", "z")
#: Names of cell indices, along z, y and x.
INDICES = ("k", "j", "i")


def directions(rank: int) -> list[tuple[int, ...]]:
    """(direction, dx, dy[, dz]) of each face; direction 2 * dim + positive, the last dimension is x."""
    out = []
    for dim in range(rank):
        for positive in (0, 1):
            step = [0] * rank
            step[rank - 1 - dim] = 2 * positive - 1
            out.append((2 * dim + positive, *step))
    return out


DIRECTIONS = tuple(directions(2))

STABLE, REFINE, COARSEN = "stable", "refine", "coarsen"


def opposite(direction: int) -> int:
    return direction ^ 1


def boundary_children(direction: int, rank: int = 2) -> list[int]:
    """Children of a patch that touch its face of a direction."""
    bit = rank - 1 - direction // 2
    return [k for k in range(1 << rank) if (k >> bit) & 1 == direction % 2]


def with_coords(keys: DataFrame, codec: MortonCodec) -> DataFrame:
    """patch_id with its level and corner."""
    corner = [c.alias(a) for c, a in zip(codec.coords(F.col("patch_id")), AXES, strict=False)]
    return keys.select("patch_id", codec.level(F.col("patch_id")).alias("level"), *corner)


def root(spark: SparkSession, codec: MortonCodec) -> DataFrame:
    return with_coords(spark.range(1).select(F.lit(0).cast("long").alias("patch_id")), codec)


def uniform(spark: SparkSession, codec: MortonCodec, level: int, trees: DataFrame | None = None) -> DataFrame:
    """All patches of one level, made in parallel; of every tree of ``trees`` (a column of numbers), or of one."""
    shift, n = codec.rank * (codec.depth - level) + 6, 1 << (codec.rank * level)
    if trees is None:
        codes = spark.range(n).select("id")
    else:
        first = F.col(trees.columns[0]).cast("long") * n
        codes = trees.select(F.explode(F.sequence(first, first + (n - 1))).alias("id"))
    return with_coords(codes.select(F.shiftleft("id", shift).bitwiseOR(F.lit(level).cast("long")).alias("patch_id")), codec)


def neighbors(leaves: DataFrame, codec: MortonCodec, of: DataFrame | None = None, periodic: bool = True) -> DataFrame:
    """patch_id, dir, relation (same, coarser, finer, boundary), n_id: one row per neighbour across a face.

    On a leaf set in which levels across faces differ by one at most, each face has one row, or one for
    each finer neighbour (two, or four in three dimensions).  ``of`` has the leaves whose faces are worked
    out, all by default.  In a domain that is not periodic an outer face's row is ``boundary``, to the leaf itself.
    """
    around = directions(codec.rank)
    own = F.col("patch_id")
    faces = F.array(*(F.struct(F.lit(d).alias("dir"), codec.neighbor(own, step, periodic=periodic).alias("at")) for d, *step in around))
    wanted = (leaves if of is None else of).select("patch_id", F.explode(faces).alias("f")).select("patch_id", "f.dir", "f.at")
    # Candidates of each case; whichever is a leaf is the neighbour, so one join finds all.
    finer = [
        F.when(
            F.col("dir") == d,
            F.array(*(F.struct(F.lit("finer").alias("relation"), codec.child(F.col("at"), k).alias("n_id")) for k in boundary_children(opposite(d), codec.rank))),
        )
        for d, *_ in around
    ]
    candidates = F.concat(
        F.array(
            F.struct(F.lit("same").alias("relation"), F.col("at").alias("n_id")),
            F.struct(F.lit("coarser").alias("relation"), codec.parent(F.col("at")).alias("n_id")),
        ),
        F.coalesce(*finer),
    )
    found = (
        wanted.select("patch_id", "dir", F.explode(candidates).alias("c"))
        .select("patch_id", "dir", "c.relation", "c.n_id")
        .join(leaves.select(F.col("patch_id").alias("n_id")), "n_id", "left_semi")
        .select("patch_id", "dir", "relation", "n_id")
    )
    if periodic:
        return found
    return found.unionByName(wanted.filter("at is null").select("patch_id", "dir", F.lit("boundary").alias("relation"), own.alias("n_id")))


def updated_neighbors(
    links: DataFrame, leaves: DataFrame, gone: DataFrame, born: DataFrame, codec: MortonCodec, fresh: DataFrame | None = None
) -> DataFrame:
    """The neighbour table after a pass, from the one before: only faces of ``born`` leaves are worked out.

    ``links`` may be the part of the table whose leaves are at or beside ``gone`` ones; ``leaves`` are
    the new ones there.  Rows of and to leaves that are gone go; a new leaf's face gives the row of the
    leaf beyond it too.  ``fresh``, the faces of born leaves, can be given where it has been written.
    """
    fresh = neighbors(leaves, codec, born) if fresh is None else fresh
    kept = links.join(gone.select("patch_id"), "patch_id", "left_anti").join(
        gone.select(F.col("patch_id").alias("n_id")), "n_id", "left_anti"
    )
    inverse = F.when(F.col("relation") == "coarser", "finer").when(F.col("relation") == "finer", "coarser").otherwise(F.col("relation"))
    back = fresh.join(born.select(F.col("patch_id").alias("n_id")), "n_id", "left_anti").select(
        F.col("n_id").alias("patch_id"), F.col("dir").bitwiseXOR(F.lit(1)).alias("dir"), inverse.alias("relation"), F.col("patch_id").alias("n_id")
    )
    names = ["patch_id", "dir", "relation", "n_id"]
    return kept.select(*names).unionByName(fresh.select(*names)).unionByName(back)


def eligible(flags: DataFrame, codec: MortonCodec) -> DataFrame:
    """patch_id of leaves flagged to refine that are above full depth."""
    return flags.filter((F.col("status") == REFINE) & (codec.level(F.col("patch_id")) < codec.depth)).select("patch_id")


def coarsen_families(flags: DataFrame, codec: MortonCodec, min_level: int = 1) -> DataFrame:
    """patch_id of parents all of whose children are leaves flagged to coarsen.

    A parent above ``min_level`` - 1 stays refined; the default only spares the root.
    """
    return (
        flags.filter(codec.level(F.col("patch_id")) > min_level)
        .groupBy(codec.parent(F.col("patch_id")).alias("patch_id"))
        .agg(F.count("*").alias("n"), F.bool_and(F.col("status") == COARSEN).alias("every"))
        .filter((F.col("n") == codec.nd_fanout) & F.col("every"))
        .select("patch_id")
    )


def _coarser_chain(codec: MortonCodec) -> Column:
    """For ``level`` and the corner: cells of each coarser level that refining this one may refine in turn.

    An array a level, from the own one up; a cell is a struct of coordinates in units of its level.  The
    cell beyond an outer face of a cell's family lies one level up; inner faces only lead to ancestors.
    """
    axes, one = AXES[: codec.rank], F.lit(1).cast("long")

    def up(cells: Column, level: Column) -> Column:
        extent = F.call_function("shiftleft", one, level)

        def beyond(cell: Column, across: str) -> Column:
            half = {a: F.shiftright(cell[a], 1) for a in axes}
            half[across] = F.pmod(half[across] + cell[across].bitwiseAND(one) * 2 - 1, extent)
            return F.struct(*(half[a].alias(a) for a in axes))

        return F.array_distinct(F.flatten(F.transform(cells, lambda c: F.array(*(beyond(c, a) for a in axes)))))

    own = F.struct(*(F.call_function("shiftright", F.col(a), F.lit(codec.depth) - F.col("level")).alias(a) for a in axes))
    steps = F.filter(F.sequence(F.lit(0), F.col("level")), lambda n: n > 0)
    return F.aggregate(steps, F.array(F.array(own)), lambda acc, n: F.concat(acc, F.array(up(F.element_at(acc, -1), F.col("level") - n))))


def balance_refinement(wanted: DataFrame, leaves: DataFrame, codec: MortonCodec) -> DataFrame:
    """patch_id of the leaves to refine so that no face ends with levels two apart.

    All cells that a wanted leaf could force, level by level, are worked out from its key; those that
    are leaves are the answer: one aggregate and one semi-join, whatever the depth.  On a leaf set in
    which levels across faces differ by one at most, a chain that meets a cell that is no leaf meets
    none later: the cell is refined already, so what lies beyond its faces is too.
    """
    axes, unit = AXES[: codec.rank], F.lit(codec.depth) - F.col("level")
    cells = (
        with_coords(wanted, codec)
        .select("patch_id", "level", F.posexplode(_coarser_chain(codec)).alias("up", "cells"))
        .select("patch_id", (F.col("level") - F.col("up")).alias("level"), F.explode("cells").alias("cell"))
    )
    corner = [F.call_function("shiftleft", F.col(f"cell.{a}"), unit) for a in axes]
    reached = cells.select(codec.encode(corner, F.col("level"), codec.tree(F.col("patch_id"))).alias("patch_id")).distinct()
    return reached.join(leaves.select("patch_id"), "patch_id", "left_semi")


def prune_coarsening(families: DataFrame, refined: DataFrame, nbr: DataFrame, codec: MortonCodec) -> DataFrame:
    """Families without a child whose neighbour is finer, or is of the same level and to be refined.

    Faces between siblings count too: a sibling that is refined keeps its family.
    """
    hot = nbr.join(refined.select(F.col("patch_id").alias("n_id"), F.lit(True).alias("hot")), "n_id", "left")
    blocked = hot.filter((F.col("relation") == "finer") | ((F.col("relation") == "same") & F.col("hot"))).select(
        codec.parent(F.col("patch_id")).alias("patch_id")
    )
    return families.join(blocked, "patch_id", "left_anti")


def changes(refined: DataFrame, families: DataFrame, codec: MortonCodec) -> tuple[DataFrame, DataFrame]:
    """(leaves that go, leaves that are born) of a pass, as patch_id."""
    children = F.explode(codec.children(F.col("patch_id"))).alias("patch_id")
    gone = refined.select("patch_id").unionByName(families.select(children))
    return gone, refined.select(children).unionByName(families.select("patch_id"))


def regrid_keys(leaves: DataFrame, refined: DataFrame, families: DataFrame, codec: MortonCodec) -> DataFrame:
    """The leaf set with refined leaves replaced by their children and families by their parents."""
    gone, born = changes(refined, families, codec)
    return with_coords(leaves.select("patch_id").join(gone, "patch_id", "left_anti").unionByName(born), codec)


def plan_regrid(
    leaves: DataFrame, flags: DataFrame, codec: MortonCodec, min_level: int = 1, nbr: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(keys to refine, parents to coarsen to) under balance, from ``flags`` (patch_id, status).

    ``nbr`` is the neighbour table where there is one.
    """
    refined = balance_refinement(eligible(flags, codec), leaves, codec).checkpoint()
    families = prune_coarsening(coarsen_families(flags, codec, min_level), refined, neighbors(leaves, codec) if nbr is None else nbr, codec)
    return refined, families


def reconstruct(leaves: DataFrame, flags: DataFrame, codec: MortonCodec, min_level: int = 1) -> DataFrame:
    """One pass of refinement and coarsening of the leaf set."""
    refined, families = plan_regrid(leaves, flags, codec, min_level)
    return regrid_keys(leaves, refined, families, codec)


def is_noop(refined: DataFrame, families: DataFrame) -> bool:
    return refined.isEmpty() and families.isEmpty()


def sort_by_key(frame: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range-partitioned and sorted by key: each partition is a piece of space."""
    by = ("patch_id",)
    dealt = frame.repartitionByRange(partitions, *by) if partitions else frame.repartitionByRange(*by)
    return dealt.sortWithinPartitions("patch_id")


def lookup(frame: DataFrame, keys: list[int]) -> DataFrame:
    """Rows of some patches; the filter reaches the scan."""
    return frame.filter(F.col("patch_id").isin(keys))


def same_topology(a: DataFrame, b: DataFrame) -> bool:
    keys = a.select("patch_id"), b.select("patch_id")
    return keys[0].exceptAll(keys[1]).isEmpty() and keys[1].exceptAll(keys[0]).isEmpty()


def indent(leaves: DataFrame) -> DataFrame:
    """One line of text per leaf, indented by level; order by patch_id to print."""
    line: Column = F.concat(F.repeat(F.lit("  "), F.col("level")), F.lit("level "), F.col("level"), F.lit(" at "), F.concat_ws(",", *(F.col(a) for a in AXES if a in leaves.columns)))
    return leaves.select("patch_id", line.alias("line"))


def is_sorted(frame: DataFrame) -> DataFrame:
    """One row, ``sorted``: whether ``place`` (from 1) numbers the rows in order of patch_id, each once.

    A row's successor is found by an equi-join on the place, so no task sees all rows.
    """
    rows = frame.select("place", "patch_id")
    after = rows.select((F.col("place") - 1).alias("place"), F.col("patch_id").alias("next"))
    faults = rows.join(after, "place").filter(F.col("next") <= F.col("patch_id"))
    shape = rows.agg(F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"), F.sum("place").alias("total"))
    whole = (F.col("n") == 0) | ((F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("total") * 2 == F.col("n") * (F.col("n") + 1)))
    return shape.join(F.broadcast(faults.agg(F.count("*").alias("faults")))).select((whole & (F.col("faults") == 0)).alias("sorted"))


def index_faults(leaves: DataFrame, places: DataFrame) -> DataFrame:
    """Keys of a leaf set and of its map of places (patch_id, place) that do not match one to one."""
    named = places.groupBy("patch_id").agg(F.count("*").alias("n"))
    twice = places.groupBy("place").agg(F.count("*").alias("n"), F.min("patch_id").alias("patch_id")).filter("n > 1")
    both = leaves.select("patch_id", F.lit(1).alias("leaf")).join(named, "patch_id", "full")
    wrong = both.filter(F.col("leaf").isNull() | F.col("n").isNull() | (F.col("n") > 1)).select("patch_id")
    return wrong.unionByName(twice.select("patch_id")).distinct()
