"""Halo exchange: the cells beyond each face of a patch, from the cells of its neighbours.

Cells are rows (patch_id, level, [k,] j, i, fields); k runs along z, j along y, i along x.  Halo rows
get indices -halo..-1 or n..n+halo-1 and are never stored.  A neighbour of the same level is copied, a
coarser one covers (its value is copied), finer ones are averaged over the cells under the halo cell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.morton import MortonCodec
from .layout import PatchLayout
from .tree import INDICES, neighbors


def _geometry(codec: MortonCodec, n: int, away: Column, along_face: Sequence[Column]) -> tuple[list[Column], Column, Column]:
    """(indices of a halo cell, array of the source cells' indices, whether this finer neighbour feeds it).

    Of a row of neighbours (patch_id, dir, relation, n_id); ``away`` are cells from the face, ``along_face`` places on it.
    """
    rank = codec.rank
    names, dims = INDICES[-rank:], range(rank)
    positive, axis = F.col("dir") % 2 == 1, F.floor(F.col("dir") / 2)

    def along(d: int) -> Column:
        """The place along dimension ``d``, where that is not the face's own."""
        before, after = along_face[min(d, rank - 2)], along_face[max(d - 1, 0)]
        return F.when(axis > d, before).otherwise(after)

    def bit(key: str, d: int) -> Column:
        return F.shiftright(codec.offset_of(F.col(key)), rank - 1 - d).bitwiseAND(1)

    def one(normal: Column, other: Callable[[int], Column]) -> Column:
        return F.array(F.struct(*(F.when(axis == d, normal).otherwise(other(d)).cast("int").alias(m) for d, m in enumerate(names))))

    place = F.when(positive, away + n).otherwise(-1 - away)
    half = F.lit(n // 2)
    same = one(F.when(positive, away).otherwise(n - 1 - away), along)
    mirror = one(F.when(positive, n - 1 - away).otherwise(away), along)
    under = F.floor(away / 2)
    coarser = one(F.when(positive, under).otherwise(n - 1 - under), lambda d: F.floor((along(d) + bit("patch_id", d) * n) / 2))
    first = F.when(positive, away * 2).otherwise(n - 2 - away * 2)
    finer = F.array(
        *(
            F.struct(*((F.when(axis == d, first).otherwise((along(d) % half) * 2) + F.lit(o)).cast("int").alias(m) for d, (m, o) in enumerate(zip(names, part, strict=True))))
            for part in product((0, 1), repeat=rank)
        )
    )
    # Each finer neighbour feeds its own part of the face.
    own_part = reduce(lambda x, y: x & y, ((axis == d) | (F.floor(along(d) / half) == bit("n_id", d)) for d in dims))
    relation = F.col("relation")
    sources = F.when(relation == "same", same).when(relation == "coarser", coarser).when(relation == "boundary", mirror).otherwise(finer)
    indices = [F.when(axis == d, place).otherwise(along(d)).cast("int") for d in dims]
    return indices, sources, (relation != "finer") | own_part


def _square(codec: MortonCodec, layout: PatchLayout) -> int:
    n = layout.sizes[0]
    if layout.sizes != (n,) * codec.rank:
        raise ValueError("patches of one size along all dimensions")
    return n


def halo_sources(leaves: DataFrame, codec: MortonCodec, layout: PatchLayout, nbr: DataFrame | None = None) -> DataFrame:
    """Which cells feed each halo cell: patch_id, level, dir, its indices, relation, n_id, and theirs (n before the name).

    One row for same, coarser and boundary (the patch's own cell as far inside), four (eight in three
    dimensions) for finer.
    """
    rank, n, halo = codec.rank, _square(codec, layout), layout.halo
    names = INDICES[-rank:]
    nbr = neighbors(leaves, codec) if nbr is None else nbr
    rows = nbr.select("patch_id", "dir", "relation", "n_id", codec.level(F.col("patch_id")).alias("level"))
    # h: cells away from the face; t: places along it.
    for name, count in [("__h", halo), *((f"__t{d}", n) for d in range(rank - 1))]:
        rows = rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    indices, sources, fed = _geometry(codec, n, F.col("__h"), [F.col(f"__t{d}") for d in range(rank - 1)])
    rows = rows.filter(fed).withColumn("__s", F.explode(sources))
    return rows.select(
        "patch_id",
        "level",
        "dir",
        *(c.alias(m) for c, m in zip(indices, names, strict=True)),
        "relation",
        "n_id",
        *(F.col(f"__s.{m}").alias(f"n{m}") for m in names),
    )


@dataclass(frozen=True)
class HaloOperators:
    """What a halo cell is made of in each case: (array of source values, field, axis of the face) to a value.

    Same, coarser and boundary have one source, finer four (eight in three dimensions).  The axis is a
    column, counted like directions (0 is the first index).  The default wall is symmetric.
    """

    same: Callable[[Column, str, Column], Column] = lambda v, f, a: F.get(v, F.lit(0))
    coarser: Callable[[Column, str, Column], Column] = lambda v, f, a: F.get(v, F.lit(0))
    boundary: Callable[[Column, str, Column], Column] = lambda v, f, a: F.get(v, F.lit(0))
    finer: Callable[[Column, str, Column], Column] = lambda v, f, a: F.aggregate(v, F.lit(0.0), lambda x, y: x + y) / F.size(v)


def patch_rows(cells: DataFrame, layout: PatchLayout, fields: Sequence[str]) -> DataFrame:
    """A row a patch: patch_id and an array for each field, row-major over the interior."""
    names = INDICES[-layout.rank :]
    flat = _flat(layout, [F.col(m) for m in names])
    packed = F.transform(F.array_sort(F.collect_list(F.struct(flat.alias("at"), *fields))), lambda c: F.struct(*(c[f].alias(f) for f in fields)))
    return cells.groupBy("patch_id").agg(packed.alias("v")).select("patch_id", *(F.col(f"v.{f}").alias(f) for f in fields))


def _flat(layout: PatchLayout, index: Sequence[Column]) -> Column:
    out = F.lit(0)
    for i, n in zip(index, layout.sizes, strict=True):
        out = out * n + i
    return out.cast("int")


def _values(array: Column, sources: Column, layout: PatchLayout, names: Sequence[str]) -> Column:
    """The values of a patch's array at some cells."""
    return F.transform(sources, lambda s: F.get(array, _flat(layout, [s[m] for m in names])))


def patch_halos(
    links: DataFrame, patches: DataFrame, codec: MortonCodec, layout: PatchLayout, fields: Sequence[str], using: HaloOperators | None = None
) -> DataFrame:
    """The same as ``halo_exchange`` from a table of neighbours and one of patches (``patch_rows``).

    One equi-join on the neighbour's key brings a patch's arrays to each face; a halo cell's sources all
    lie in one neighbour, so no aggregate follows.  Where both tables are bucketed by that key, nothing is shuffled.
    """
    using = using or HaloOperators()
    rank, n = codec.rank, _square(codec, layout)
    names, face = INDICES[-rank:], n ** (rank - 1)
    met = links.select("patch_id", "dir", "relation", "n_id").join(
        patches.select(F.col("patch_id").alias("n_id"), *(F.col(f).alias(f"__{f}") for f in fields)), "n_id"
    )
    axis = F.floor(F.col("dir") / 2)

    def cell(q: Column) -> Column:
        places = [F.floor(q / n ** (rank - 2 - d)) % n for d in range(rank - 1)]
        indices, sources, fed = _geometry(codec, n, F.floor(q / face), places)
        values = []
        for f in fields:
            given = _values(F.col(f"__{f}"), sources, layout, names)
            case = F.when(F.col("relation") == "same", using.same(given, f, axis)).when(F.col("relation") == "coarser", using.coarser(given, f, axis))
            values.append(case.when(F.col("relation") == "boundary", using.boundary(given, f, axis)).otherwise(using.finer(given, f, axis)).alias(f))
        return F.when(fed, F.struct(*(c.alias(m) for c, m in zip(indices, names, strict=True)), *values))

    cells = F.filter(F.transform(F.sequence(F.lit(0), F.lit(layout.halo * face - 1)), cell), lambda c: c.isNotNull())
    return met.select("patch_id", codec.level(F.col("patch_id")).alias("level"), "dir", "relation", F.explode(cells).alias("c")).select(
        "patch_id", "level", "dir", *(f"c.{m}" for m in names), "relation", *(f"c.{f}" for f in fields)
    )


#: Slot of a patch's own values in ``with_faces``; a whole face has its direction, a half of one 4 + 2 * direction + half.
_OWN = -1


def _given(array: Column, n: int) -> Column:
    """What a neighbour gives to the cells just outside a face, in order along it: n values, n / 2 of a finer one (means of four).

    ``__first`` is the neighbour's cell at the face, ``__deep`` the finer one's first cell there, ``__along`` and ``__in`` are
    steps along the face and away from it, ``__half`` is the half of the coarser patch's face.
    """
    first, along, into = F.col("__first"), F.col("__along"), F.col("__in")
    start = first + F.col("__half") * along * (n // 2)
    places = lambda count: F.array(*(F.lit(t) for t in range(count)))

    def mean(t: Column) -> Column:
        corner = F.col("__deep") + along * t * 2
        four = [F.get(array, c) for c in (corner, corner + along, corner + into, corner + along + into)]
        return sum(four[1:], four[0]) / 4

    return (
        F.when(F.col("relation") == "finer", F.transform(places(n // 2), mean))
        .when(F.col("relation") == "coarser", F.transform(places(n), lambda t: F.get(array, start + along * F.shiftright(t, 1))))
        .otherwise(F.transform(places(n), lambda t: F.get(array, first + along * t)))
    )


def with_faces(
    patches: DataFrame, leaves: DataFrame, codec: MortonCodec, layout: PatchLayout, fields: Sequence[str], nbr: DataFrame | None = None
) -> DataFrame:
    """patch_id and an array for each field: a quadtree patch's n by n values, then n just outside each face, by direction.

    The values are those of ``halo_exchange`` at width one; null where a face has no neighbour.  A patch is sent to its neighbours
    as arrays of one face each and met there by its key: no row a cell is shuffled.  Spark takes an array for one element, so the
    join carries a hint against broadcast of the patches.
    """
    n = _square(codec, layout)
    if codec.rank != 2:
        raise ValueError("patches of quadtrees")
    links = (neighbors(leaves, codec) if nbr is None else nbr).select("patch_id", "dir", "relation", "n_id")
    own = leaves.select("patch_id", F.lit(_OWN).alias("dir"), F.lit("own").alias("relation"), F.col("patch_id").alias("n_id"))
    found = links.unionByName(own).join(
        patches.hint("merge").select(F.col("patch_id").alias("n_id"), *(F.col(f).alias(f"__{f}") for f in fields)), "n_id"
    )
    across_y, upper = F.col("dir") < 2, F.col("dir") % 2 == 1
    into = F.when(across_y, n).otherwise(1)

    def half(key: str) -> Column:
        offset = codec.offset_of(F.col(key))
        return F.when(across_y, offset.bitwiseAND(1)).otherwise(F.shiftright(offset, 1).bitwiseAND(1)).cast("int")

    relation = F.col("relation")
    met = found.withColumns(
        {
            "__in": into,
            "__along": F.when(across_y, 1).otherwise(n),
            "__first": F.when(upper == (relation != "boundary"), 0).otherwise(n - 1) * into,
            "__deep": F.when(upper, 0).otherwise(n - 2) * into,
            "__half": F.when(relation == "finer", half("n_id")).otherwise(half("patch_id")),
        }
    )
    slot = F.when(relation == "finer", F.col("dir") * 2 + F.col("__half") + 4).otherwise(F.col("dir"))
    values = F.struct(*(F.when(relation == "own", F.col(f"__{f}")).otherwise(_given(F.col(f"__{f}"), n)).alias(f) for f in fields))
    sent = met.select("patch_id", slot.cast("int").alias("slot"), values.alias("v")).repartition("patch_id")
    whole = sent.groupBy("patch_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m"))
    none = F.array_repeat(F.lit(None).cast("double"), n // 2)

    def part(slot: int, f: str) -> Column:
        return F.element_at("m", F.lit(slot))[f]

    def face(d: int, f: str) -> Column:
        return F.coalesce(part(d, f), F.concat(*(F.coalesce(part(4 + 2 * d + h, f), none) for h in (0, 1))))

    kept = whole.filter(F.element_at("m", F.lit(_OWN)).isNotNull())
    return kept.select("patch_id", *(F.concat(part(_OWN, f), *(face(d, f) for d in range(4))).alias(f) for f in fields))


def halo_exchange(
    cells: DataFrame,
    leaves: DataFrame,
    codec: MortonCodec,
    layout: PatchLayout,
    fields: Sequence[str],
    nbr: DataFrame | None = None,
    combine: Callable[[Column], Column] = F.avg,
) -> DataFrame:
    """patch_id, level, dir, indices, relation and the fields of every halo cell across a face.

    ``combine`` is the aggregate of a halo cell's sources; same and coarser have one source only.
    """
    names = INDICES[-codec.rank :]
    sources = halo_sources(leaves, codec, layout, nbr)
    given = cells.select(F.col("patch_id").alias("n_id"), *(F.col(m).alias(f"n{m}") for m in names), *fields)
    found = sources.join(given, ["n_id", *(f"n{m}" for m in names)])
    return found.groupBy("patch_id", "level", "dir", *names, "relation").agg(*(combine(F.col(f)).alias(f) for f in fields))


def padded(
    cells: DataFrame, leaves: DataFrame, codec: MortonCodec, layout: PatchLayout, fields: Sequence[str], nbr: DataFrame | None = None
) -> DataFrame:
    """Interior and face-halo cells together, with ``inside``."""
    keep = ["patch_id", "level", *INDICES[-codec.rank :], *fields]
    inner = cells.select(*keep).withColumn("inside", F.lit(True))
    outer = halo_exchange(cells, leaves, codec, layout, fields, nbr).select(*keep).withColumn("inside", F.lit(False))
    return inner.unionByName(outer)
