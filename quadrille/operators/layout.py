"""Shape of a patch: interior cells, halo width, and the index ranges they give."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod

from pyspark.sql import Column


@dataclass(frozen=True)
class PatchLayout:
    """``sizes`` of the interior (last dimension fastest and along x) and ``halo`` cells on each side."""

    sizes: tuple[int, ...]
    halo: int = 1
    fanout: int = 2

    def __post_init__(self):
        if any(n % self.fanout for n in self.sizes):
            raise ValueError("every size must be a multiple of the fanout")
        if any(n < self.halo * self.fanout for n in self.sizes):
            raise ValueError("sizes must be at least halo * fanout")

    @property
    def rank(self) -> int:
        return len(self.sizes)

    @property
    def padded(self) -> tuple[int, ...]:
        return tuple(n + 2 * self.halo for n in self.sizes)

    @property
    def cells(self) -> int:
        return prod(self.sizes)

    def strides(self) -> tuple[int, ...]:
        p = self.padded
        return tuple(prod(p[i + 1 :]) for i in range(len(p)))

    def is_halo(self, index: Sequence[Column]) -> Column:
        """In the halo band of any dimension (padded index)."""
        return reduce(lambda a, b: a | b, [(i < self.halo) | (i >= n + self.halo) for i, n in zip(index, self.sizes, strict=True)])

    def in_interior(self, index: Sequence[Column]) -> Column:
        return ~self.is_halo(index)

    def in_face_halo(self, index: Sequence[Column], dim: int, positive: bool) -> Column:
        """In the halo slab of one face; corners belong to no slab."""
        parts = []
        for d, (i, n) in enumerate(zip(index, self.sizes, strict=True)):
            if d != dim:
                parts.append((i >= self.halo) & (i < n + self.halo))
            elif positive:
                parts.append((i >= n + self.halo) & (i < n + 2 * self.halo))
            else:
                parts.append((i >= 0) & (i < self.halo))
        return reduce(lambda a, b: a & b, parts)
