"""Rows of stored tables by key, by box and by place.

Keys and boxes become literal filters on zone and key: Spark opens only the zones and buckets that can
hold them, and skips row groups by their key statistics and Bloom filters.  Places in a table are
joined instead, in the buckets that are there.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.morton import LEVEL_BITS, MortonCodec
from .store import Store
from .tree import AXES

#: Ranges of keys that a box is cut into at most; what they hold beyond the box is filtered by coordinates.
MOST_RANGES = 32


def cells_of_box(codec: MortonCodec, low: Sequence[int], high: Sequence[int], most: int = MOST_RANGES) -> list[tuple[int, tuple[int, ...]]]:
    """(level, corner) of at most ``most`` cells, none inside another, that cover all places with low <= place < high.

    Cells that lie partly outside are parted while there is room, so that few of them reach beyond the box.
    """
    whole: list = []
    partly = [(0, (0,) * codec.rank)]
    for level in range(codec.depth + 1):
        side = codec.extent >> level
        if level:
            sons = [tuple(a + side * o for a, o in zip(c, step, strict=True)) for _, c in partly for step in product((0, 1), repeat=codec.rank)]
            meets = [c for c in sons if all(a < h and a + side > b for a, b, h in zip(c, low, high, strict=True))]
            if len(whole) + len(meets) > most:
                break
        else:
            meets = [partly[0][1]]
        inside = [all(b <= a and a + side <= h for a, b, h in zip(c, low, high, strict=True)) for c in meets]
        whole += [(level, c) for c, i in zip(meets, inside, strict=True) if i]
        partly = [(level, c) for c, i in zip(meets, inside, strict=True) if not i]
    return whole + partly


def key_ranges(codec: MortonCodec, cells: Sequence[tuple[int, tuple[int, ...]]], tree: int = 0, from_level: int = 0) -> list[tuple[int, int]]:
    """Ranges (both ends included) of all keys of patches in or around cells, from a level on; sorted, touching ones merged."""
    found = set()
    for level, corner in cells:
        first = codec.key(corner, level, tree) - level
        found.add((first, first + (1 << (codec.rank * (codec.depth - level) + LEVEL_BITS)) - 1))
        for up in range(from_level, level):
            side = codec.extent >> up
            key = codec.key([a // side * side for a in corner], up, tree)
            found.add((key, key))
    merged: list[tuple[int, int]] = []
    for low, high in sorted(found):
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = merged[-1][0], max(high, merged[-1][1])
        else:
            merged.append((low, high))
    return merged


def _within(column: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    tests = [column == low if low == high else column.between(low, high) for low, high in ranges]
    return reduce(Column.__or__, tests, F.lit(False))


def by_keys(store: Store, table: str, keys: Sequence[int]) -> DataFrame:
    """A stored table's rows of some patches, as many as a filter may name (thousands; see ``by_places`` for tables).

    Keys that are not stored, null or given twice add nothing.
    """
    keys = sorted({k for k in keys if k is not None})
    zones = sorted({store.zone_of(k) for k in keys})
    return store.read(table).filter(F.col("zone").isin(zones) & F.col("patch_id").isin(keys)).drop("zone")


def by_box(store: Store, table: str, low: Sequence[int], high: Sequence[int], tree: int = 0) -> DataFrame:
    """A stored table's rows of the patches of a tree that hold a place with low <= place < high.

    Places are in units of the finest grid, the first of them along x; an empty box has no rows.
    """
    codec = store.codec
    if any(a >= b for a, b in zip(low, high, strict=True)):
        return store.read(table).filter(F.lit(False)).drop("zone")
    ranges = key_ranges(codec, cells_of_box(codec, low, high), tree, max(store.zone_level, 0))
    # A range of keys is a range of zones; those within a zone share it.
    zones = key_zones(store, ranges)
    key = F.col("patch_id")
    side = codec.side(codec.level(key))
    meets = reduce(Column.__and__, ((c < b) & (c + side > a) for c, a, b in zip(codec.coords(key), low, high, strict=True)))
    return store.read(table).filter(_within(F.col("zone"), zones) & _within(key, ranges) & meets).drop("zone")


def key_zones(store: Store, ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The zones of sorted ranges of keys, as sorted ranges."""
    merged: list[tuple[int, int]] = []
    for low, high in ((store.zone_of(a), store.zone_of(b)) for a, b in ranges):
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = merged[-1][0], max(high, merged[-1][1])
        else:
            merged.append((low, high))
    return merged


def by_places(store: Store, table: str, places: DataFrame, tree: Column | None = None) -> DataFrame:
    """``places`` (x, y[, z] and other columns) with patch_id and the columns of the stored patch that holds each.

    Distinct places look for their patch, a key for each level, in the buckets of the table; rows get it
    by the place, so that a place with very many rows can be split.  Places with a null coordinate, or
    that no patch holds, have no row.  ``tree`` numbers the tree of a place, the first one by default.
    Columns of ``places`` may not be named like those of the table.
    """
    codec = store.codec
    named = places.withColumn("__place", codec.encode([F.col(a) for a in AXES[: codec.rank]], codec.depth, tree))
    levels = [(codec.depth - up, F.shiftright("__place", LEVEL_BITS + codec.rank * up)) for up in range(codec.depth - max(store.zone_level, 0) + 1)]
    keys = [F.shiftleft(code, LEVEL_BITS + codec.rank * (codec.depth - level)).bitwiseOR(F.lit(level).cast("long")) for level, code in levels]
    wanted = named.filter("__place is not null").select("__place").distinct().select("__place", F.explode(F.array(*keys)).alias("patch_id"))
    found = store.read(table).drop("zone").join(wanted, "patch_id")
    return named.join(found, "__place").drop("__place")
