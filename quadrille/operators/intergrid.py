"""Moving cell values between levels, and the refinement criteria that ask for it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.morton import MortonCodec
from .tree import COARSEN, INDICES, REFINE, STABLE


def restrict(
    cells: DataFrame, codec: MortonCodec, n: int, fields: Sequence[str], combine: Callable[[Column], Column] = F.avg
) -> DataFrame:
    """Families of fine cells to their parents: ``combine`` (the mean) over each block of two cells a side.

    ``cells`` must hold whole families of patches of n cells a side.
    """
    names, child, half = INDICES[-codec.rank :], codec.offset_of(F.col("patch_id")), n // 2
    bit = lambda d: F.shiftright(child, codec.rank - 1 - d).bitwiseAND(1)
    return (
        cells.select(
            codec.parent(F.col("patch_id")).alias("patch_id"),
            *((bit(d) * half + F.floor(F.col(m) / 2)).cast("int").alias(m) for d, m in enumerate(names)),
            *fields,
        )
        .groupBy("patch_id", *names)
        .agg(*(combine(F.col(f)).alias(f) for f in fields))
        .select("patch_id", codec.level(F.col("patch_id")).alias("level"), *names, *fields)
    )


def restrict_patches(
    patches: DataFrame, codec: MortonCodec, n: int, fields: Mapping[str, tuple[str, Callable[[Sequence[Column]], Column]]]
) -> DataFrame:
    """``restrict`` of a table of patches (``halo.patch_rows``): a row a coarse cell, without a shuffle.

    Two cells a side make one, and n is even, so all that a coarse cell is made of lies in one patch.
    ``fields`` are (array, function of the fine values, in row-major order) by the name of the result.
    Patches without a parent have no row.
    """
    names, child, half = INDICES[-codec.rank :], codec.offset_of(F.col("patch_id")), n // 2
    blocks = []
    for place in product(range(half), repeat=codec.rank):
        under = []
        for part in product((0, 1), repeat=codec.rank):
            flat = 0
            for p, o in zip(place, part, strict=True):
                flat = flat * n + 2 * p + o
            under.append(flat)
        values = [combine([F.get(a, F.lit(k)) for k in under]).alias(f) for f, (a, combine) in fields.items()]
        blocks.append(F.struct(*(F.lit(p).alias(m) for m, p in zip(names, place, strict=True)), *values))
    bit = lambda d: F.shiftright("__o", codec.rank - 1 - d).bitwiseAND(1)
    rows = patches.filter(codec.level(F.col("patch_id")) > 0).select(codec.parent(F.col("patch_id")).alias("patch_id"), child.alias("__o"), F.inline(F.array(*blocks)))
    return rows.select(
        "patch_id", codec.level(F.col("patch_id")).alias("level"), *((bit(d) * half + F.col(m)).cast("int").alias(m) for d, m in enumerate(names)), *fields
    )


def prolong_patches(
    patches: DataFrame,
    codec: MortonCodec,
    n: int,
    fields: Sequence[str],
    spread: Callable[[Column, Sequence[Column]], Column] = lambda value, place: value,
) -> DataFrame:
    """``prolong`` of a table of patches with ``level``: a child's key is worked out once a patch, its cells come from the arrays."""
    names, half = INDICES[-codec.rank :], n // 2
    sons = []
    for part in product((0, 1), repeat=codec.rank):
        number = 0
        for o in part:
            number = number * 2 + o
        cells = []
        for place in product(range(half), repeat=codec.rank):
            flat = 0
            for p, o in zip(place, part, strict=True):
                flat = flat * n + o * half + p
            cells.append(F.struct(*(F.lit(2 * p).alias(m) for m, p in zip(names, place, strict=True)), *(F.get(f, F.lit(flat)).alias(f) for f in fields)))
        sons.append(F.struct(codec.child(F.col("patch_id"), number).alias("patch_id"), F.array(*cells).alias("__c")))
    coarse = patches.select((F.col("level") + 1).alias("level"), F.inline(F.array(*sons))).select("patch_id", "level", F.inline("__c"))
    parts = F.array(*(F.struct(*(F.lit(o).alias(f"__{m}") for m, o in zip(names, part, strict=True))) for part in product((0, 1), repeat=codec.rank)))
    place = [F.col(f"__{m}") for m in names]
    return coarse.select("*", F.inline(parts)).select(
        "patch_id", "level", *((F.col(m) + p).cast("int").alias(m) for m, p in zip(names, place, strict=True)), *(spread(F.col(f), place).alias(f) for f in fields)
    )


def prolong(
    cells: DataFrame,
    codec: MortonCodec,
    n: int,
    fields: Sequence[str],
    spread: Callable[[Column, Sequence[Column]], Column] = lambda value, place: value,
) -> DataFrame:
    """Each cell to the cells of the child that covers it, two a side.

    ``spread`` gives a fine cell's value from the coarse one and its place in it (0 or 1 along each
    dimension, in order of the indices); the default copies.
    """
    names, half = INDICES[-codec.rank :], n // 2
    number = F.lit(0)
    for m in names:
        number = number * 2 + F.floor(F.col(m) / half).cast("int")
    parts = F.array(*(F.struct(*(F.lit(o).alias(m) for m, o in zip(names, part, strict=True))) for part in product((0, 1), repeat=codec.rank)))
    place = [F.col(f"__p.{m}") for m in names]
    return cells.withColumn("__p", F.explode(parts)).select(
        codec.child(F.col("patch_id"), number).alias("patch_id"),
        (F.col("level") + 1).alias("level"),
        *(((F.col(m) % half) * 2 + p).cast("int").alias(m) for m, p in zip(names, place, strict=True)),
        *(spread(F.col(f), place).alias(f) for f in fields),
    )


#: What becomes of a leaf in ``regrid_patches``: 1 for given to children, -1 for brought to its parent; others are kept.
_DOWN, _UP = 1, -1


def _fates(refined: DataFrame, families: DataFrame, codec: MortonCodec) -> DataFrame:
    """patch_id, __fate of the leaves that go."""
    sons = families.select(F.explode(codec.children(F.col("patch_id"))).alias("patch_id"))
    return refined.select("patch_id", F.lit(_DOWN).alias("__fate")).unionByName(sons.select("patch_id", F.lit(_UP).alias("__fate")))


def regrid_cells(
    cells: DataFrame, refined: DataFrame, families: DataFrame, codec: MortonCodec, n: int, fields: Sequence[str], **operators
) -> DataFrame:
    """Cell values on the new leaf set: kept, given to children, brought to parents.

    ``operators``: ``combine`` of ``restrict`` and ``spread`` of ``prolong``.
    """
    keep = ["patch_id", "level", *INDICES[-codec.rank :], *fields]
    sons = families.select(F.explode(codec.children(F.col("patch_id"))).alias("patch_id"))
    gone = refined.select("patch_id").unionByName(sons)
    same = cells.select(*keep).join(gone, "patch_id", "left_anti")
    down = {k: v for k, v in operators.items() if k == "spread"}
    up = {k: v for k, v in operators.items() if k == "combine"}
    fine = prolong(cells.join(refined, "patch_id", "left_semi"), codec, n, fields, **down)
    coarse = restrict(cells.join(sons, "patch_id", "left_semi"), codec, n, fields, **up)
    return same.unionByName(fine.select(*keep)).unionByName(coarse.select(*keep))


def regrid_patches(
    patches: DataFrame,
    refined: DataFrame,
    families: DataFrame,
    codec: MortonCodec,
    n: int,
    fields: Sequence[str],
    combine: Callable[[Sequence[Column]], Column] = lambda v: sum(v[1:], v[0]) / len(v),
    spread: Callable[[Column, Sequence[Column]], Column] = lambda value, place: value,
) -> DataFrame:
    """``regrid_cells`` of a table of patches (``halo.patch_rows``): a row a cell, exploded after the last shuffle.

    A patch meets what becomes of it by its key.  The cells of its next form are listed as the places in its arrays that
    they come from: its own, those of all children, or the blocks that make its parent's.
    """
    rank, half, size = codec.rank, n // 2, n**codec.rank
    names, parts = INDICES[-rank:], list(product((0, 1), repeat=rank))
    flat = lambda place: sum(p * n ** (rank - 1 - d) for d, p in enumerate(place))

    def son(part: Sequence[int]) -> int:
        """Number of the child in a part; the last index runs along the key's first axis."""
        return sum(o << (rank - 1 - d) for d, o in enumerate(part))

    def cell(child: int, place: Sequence[int], bits: Sequence[int], *under: int) -> Column:
        at = {"c": child, **dict(zip(names, place, strict=True)), **{f"o{m}": b for m, b in zip(names, bits, strict=True)}}
        return F.struct(*(F.lit(v).alias(f"__{k}") for k, v in at.items()), F.array(*map(F.lit, under)).alias("__from"))

    none, inside = (0,) * rank, list(product(range(n), repeat=rank))
    same = [cell(0, p, none, flat(p)) for p in inside]
    fine = [
        cell(son(part), p, [k % 2 for k in p], flat([o * half + k // 2 for o, k in zip(part, p, strict=True)])) for part in parts for p in inside
    ]
    coarse = [cell(0, p, none, *(flat([2 * k + o for k, o in zip(p, part, strict=True)]) for part in parts)) for p in product(range(half), repeat=rank)]
    met = patches.select("patch_id", *(F.col(f).alias(f"__{f}") for f in fields)).join(_fates(refined, families, codec), "patch_id", "left")
    fate = F.coalesce("__fate", F.lit(0))
    listed = F.when(fate == _DOWN, F.array(*fine)).when(fate == _UP, F.array(*coarse)).otherwise(F.array(*same))
    rows = met.select("patch_id", fate.alias("__fate"), *(f"__{f}" for f in fields), F.inline(listed))
    key, part = F.col("patch_id"), codec.offset_of(F.col("patch_id"))
    given = lambda f, k: F.get(f"__{f}", F.get("__from", F.lit(k)))
    is_up, is_down = F.col("__fate") == _UP, F.col("__fate") == _DOWN
    values = []
    for f in fields:
        one = given(f, 0)
        many = combine([given(f, k) for k in range(1 << rank)])
        values.append(F.when(is_up, many).when(is_down, spread(one, [F.col(f"__o{m}") for m in names])).otherwise(one).alias(f))
    out = F.when(is_up, codec.parent(key)).when(is_down, codec.child(key, F.col("__c"))).otherwise(key)
    bit = lambda d: F.shiftright(part, rank - 1 - d).bitwiseAND(1)
    index = [(F.col(f"__{m}") + F.when(is_up, bit(d) * half).otherwise(0)).cast("int").alias(m) for d, m in enumerate(names)]
    return rows.select(out.alias("patch_id"), *index, *values).select("patch_id", codec.level(key).alias("level"), *names, *fields)


def threshold_flags(
    cells: DataFrame, value: Column, refine_above: Column | float, coarsen_below: Column | float, min_level: int, max_level: int
) -> DataFrame:
    """patch_id, peak, status: by the largest value of each patch, within level limits.

    A limit may be a column that is the same for all cells of a patch.
    """
    limit = lambda x: F.first(x if isinstance(x, Column) else F.lit(x))
    peak = cells.groupBy("patch_id", "level").agg(
        F.max(value).alias("peak"), limit(refine_above).alias("__above"), limit(coarsen_below).alias("__below")
    )
    status = (
        F.when((F.col("peak") > F.col("__above")) & (F.col("level") < max_level), REFINE)
        .when((F.col("peak") < F.col("__below")) & (F.col("level") > min_level), COARSEN)
        .otherwise(STABLE)
    )
    return peak.select("patch_id", "level", "peak", status.alias("status"))


def flags_by(patches: DataFrame, criterion: Callable[[DataFrame], DataFrame] | Column) -> DataFrame:
    """patch_id, status from an own criterion: a column of status, or a function of the table."""
    if isinstance(criterion, Column):
        return patches.select("patch_id", criterion.alias("status"))
    return criterion(patches).select("patch_id", "status")


def count_flags(flags: DataFrame) -> DataFrame:
    return flags.groupBy("status").agg(F.count("*").alias("n"))


def anomalies(frame: DataFrame, columns: Sequence[str], limit: float = 1e10) -> DataFrame:
    """For each column: how many values are NaN, infinite, or larger than ``limit`` in size."""
    one = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns)))
    v, infinite = F.col("v"), F.abs("v") == F.lit(float("inf"))
    return (
        frame.select(one.alias("r"))
        .select("r.name", "r.v")
        .groupBy("name")
        .agg(
            F.count_if(F.isnan(v)).alias("n_nan"),
            F.count_if(infinite).alias("n_inf"),
            F.count_if(~F.isnan(v) & ~infinite & (F.abs(v) > limit)).alias("n_large"),
            F.count(v).alias("n"),
        )
    )
