"""Morton (Z-order) keys of patches as column expressions.

A key is the bit interleaving of a patch's corner in units of the finest grid (x lowest), followed
by six bits of level.  The bits above the interleaved ones number the tree, so one table holds a
forest of any size and keys of different trees never meet.  All expressions are built-in bit
operations, so they stay inside generated code and a range of keys is a range of space.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVEL_BITS = 6
ROOT = 0


def _long(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("long")


def _left(x: Column, n: Column | int) -> Column:
    return F.shiftleft(x, n) if isinstance(n, int) else F.call_function("shiftleft", x, n.cast("int"))


def _right(x: Column, n: Column | int) -> Column:
    return F.shiftright(x, n) if isinstance(n, int) else F.call_function("shiftright", x, n.cast("int"))


def _or(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


class MortonCodec:
    """Keys of a tree of ``rank`` dimensions and ``depth`` levels below the root."""

    def __init__(self, rank: int = 2, depth: int = 7):
        if rank not in (2, 3):
            raise ValueError("rank must be 2 or 3")
        if rank * depth + LEVEL_BITS > 63:
            raise ValueError("keys must fit a signed 64-bit integer")
        self.rank, self.depth = rank, depth

    # Constants of the tree.
    fanout = 2

    @property
    def nd_fanout(self) -> int:
        return 1 << self.rank

    @property
    def max_depth(self) -> int:
        return self.depth

    @property
    def extent(self) -> int:
        """Finest-grid units along each axis."""
        return 1 << self.depth

    def encode(self, coords: Sequence[Column], level: Column | int, tree: Column | None = None) -> Column:
        """Key of a corner (x, y[, z]) at a level of a tree (the first one by default)."""
        bits = [self._spread_column(_long(c), axis) for axis, c in enumerate(coords)]
        above = [] if tree is None else [_left(_long(tree), self.rank * self.depth + LEVEL_BITS)]
        return _or([*above, *bits, _long(level)])

    def key(self, coords: Sequence[int], level: int, tree: int = 0) -> int:
        """``encode`` of plain numbers, for filters that name keys."""
        bits = sum(((c >> i) & 1) << (i * self.rank + axis) for axis, c in enumerate(coords) for i in range(self.depth))
        return (tree << self.rank * self.depth + LEVEL_BITS) | (bits << LEVEL_BITS) | level

    def tree(self, key: Column) -> Column:
        """The tree of a key."""
        return _right(key, self.rank * self.depth + LEVEL_BITS)

    def coords(self, key: Column) -> list[Column]:
        """x, y[, z] of a key."""
        return [self._gather_column(_right(key, LEVEL_BITS + axis)) for axis in range(self.rank)]

    def _groups(self, size: int) -> Column:
        """The places of a number's bits when each ``size`` of them are followed by room for the other axes'."""
        return F.lit(sum(1 << (i // size * size * self.rank + i % size) for i in range(self.depth))).cast("long")

    @property
    def _halvings(self) -> list[int]:
        """Powers of two below the depth, smallest first."""
        return [1 << k for k in range((self.depth - 1).bit_length())]

    def _spread_column(self, number: Column, axis: int) -> Column:
        """A number's bits at an axis's places of a key: groups of bits part in halves until each is alone."""
        out = number.bitwiseAND(F.lit(self.extent - 1).cast("long"))
        for size in reversed(self._halvings):
            out = out.bitwiseOR(_left(out, size * (self.rank - 1))).bitwiseAND(self._groups(size))
        return _left(out, axis + LEVEL_BITS)

    def _gather_column(self, code: Column) -> Column:
        """The number whose bits stand at every ``rank``-th place from the lowest."""
        out = code.bitwiseAND(self._groups(1))
        for size in self._halvings:
            out = out.bitwiseOR(_right(out, size * (self.rank - 1))).bitwiseAND(self._groups(2 * size))
        return out

    def level(self, key: Column) -> Column:
        return key.bitwiseAND(F.lit(63).cast("long")).cast("int")

    def _code(self, key: Column) -> Column:
        return _right(key, LEVEL_BITS)

    def side(self, level: Column) -> Column:
        """Finest-grid units along a patch of a level."""
        return _left(F.lit(1).cast("long"), F.lit(self.depth) - level)

    def parent(self, key: Column) -> Column:
        """Key of the parent; null for the root."""
        level = self.level(key)
        shift = (F.lit(self.depth) - level) * self.rank
        cleared = _left(_right(self._code(key), shift + self.rank), shift + self.rank)
        return F.when(level > 0, _left(cleared, LEVEL_BITS).bitwiseOR(_long(level - 1)))

    def child(self, key: Column, offset: Column | int) -> Column:
        """Key of child ``offset`` (bit 0 is x, bit 1 is y, bit 2 is z); null at full depth."""
        level = self.level(key)
        shift = (F.lit(self.depth - 1) - level) * self.rank
        code = self._code(key).bitwiseOR(_left(_long(offset), shift))
        return F.when(level < self.depth, _left(code, LEVEL_BITS).bitwiseOR(_long(level + 1)))

    def children(self, key: Column) -> Column:
        """Array of the keys of all children."""
        return F.array(*(self.child(key, k) for k in range(self.nd_fanout)))

    def offset_of(self, key: Column) -> Column:
        """Which child of its parent a key is."""
        shift = (F.lit(self.depth) - self.level(key)) * self.rank
        return _right(self._code(key), shift).bitwiseAND(F.lit(self.nd_fanout - 1).cast("long")).cast("int")

    def sibling(self, key: Column, offset: Column | int) -> Column:
        """Sibling ``offset`` of the same parent."""
        return self.child(self.parent(key), offset)

    def is_valid(self, coords: Sequence[Column], level: Column) -> Column:
        """On the grid of its level and inside the domain."""
        side = self.side(level)
        inside = [(c >= 0) & (c < self.extent) & ((c % side) == 0) for c in coords]
        return reduce(lambda a, b: a & b, inside)

    def _spread(self, n: int, axis: int) -> int:
        """The bits of a number at an axis's places of a code."""
        return sum(((n >> i) & 1) << (self.rank * i + axis) for i in range(self.depth))

    def neighbor(self, key: Column, step: Sequence[int], periodic: bool = False) -> Column:
        """Key of the same level ``step`` patches away along each axis; null outside unless periodic.

        Adds to an axis's bits in place: ones between them pass a carry on, zeros a borrow.
        """
        level, code = self.level(key), self._code(key)
        shift = (F.lit(self.depth) - level) * self.rank
        out, inside = code, []
        for axis, s in enumerate(step):
            if not s:
                continue
            own = self._spread(self.extent - 1, axis)
            mask, others = F.lit(own).cast("long"), F.lit(~own).cast("long")
            at = code.bitwiseAND(mask)
            by = _left(F.lit(self._spread(abs(s), axis)).cast("long"), shift).bitwiseAND(mask)
            moved = ((code.bitwiseOR(others) + by) if s > 0 else (at - by)).bitwiseAND(mask)
            out = out.bitwiseAND(others).bitwiseOR(moved)
            inside += [_left(F.lit(1).cast("long"), level) > abs(s), moved > at if s > 0 else moved < at]
        there = _left(out, LEVEL_BITS).bitwiseOR(_long(level))
        return there if periodic or not inside else F.when(reduce(lambda a, b: a & b, inside), there)

    def bits(self, key: Column) -> Column:
        """The key as 64 binary digits."""
        return F.lpad(F.bin(key), 64, "0")

    def hierarchical(self, key: Column) -> Column:
        """Another key: the child numbers from the root down, one digit (1 to nd_fanout) a level."""
        level, code = self.level(key), self._code(key)
        digits = [
            F.when(
                level >= i,
                (_right(code, self.rank * (self.depth - i)).bitwiseAND(F.lit(self.nd_fanout - 1).cast("long")) + 1).cast("string"),
            )
            for i in range(1, self.depth + 1)
        ]
        return F.concat_ws("", *digits)
