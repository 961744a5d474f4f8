"""Interval, sign and cast helpers, and random columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    low = F.lit(low) if isinstance(low, int | float) else low
    high = F.lit(high) if isinstance(high, int | float) else high
    return F.greatest(low, F.least(high, x))


def inside(x: Column, low: Column | float, high: Column | float) -> Column:
    return (x >= low) & (x <= high)


def lerp(low: Column | float, high: Column | float, t: Column) -> Column:
    """The point at share ``t`` of the way from low to high."""
    low = F.lit(low) if isinstance(low, int | float) else low
    return low + (high - low) * t


def unlerp(low: Column | float, high: Column | float, x: Column) -> Column:
    """The share of the way from low to high at which x lies, within [0, 1]."""
    return clamp((x - low) / (F.lit(high) - F.lit(low) if isinstance(high, int | float) else high - low), 0.0, 1.0)


def same_sign(a: Column, b: Column) -> Column:
    """Both negative or both not."""
    return (a < 0) == (b < 0)


def log_base(x: Column, base: float) -> Column:
    return F.log(x) / F.log(F.lit(float(base)))


def bits_for(n: Column) -> Column:
    """Bits that n different values take."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def int_power(x: Column, n: int) -> Column:
    """x multiplied n times; exact for integers that fit."""
    out = F.lit(1).cast("long")
    for _ in range(n):
        out = out * x
    return out


def safe_cast(x: Column, to: str, back: str) -> Column:
    """x as ``to`` if it comes back unchanged, else null."""
    there = x.try_cast(to)
    return F.when(there.try_cast(back) == x, there)


def uniform(seed: int, low: float = 0.0, high: float = 1.0) -> Column:
    return F.rand(seed) * (high - low) + low


def normal(seed: int, mean: float = 0.0, deviation: float = 1.0) -> Column:
    return F.randn(seed) * deviation + mean


def integers(seed: int, low: int, high: int) -> Column:
    """Uniform over low to high, both included."""
    return F.floor(F.rand(seed) * (high - low + 1)).cast("long") + low


def exponential(seed: int, rate: float = 1.0) -> Column:
    return -F.log(1 - F.rand(seed)) / rate


def bernoulli(seed: int, p: float = 0.5) -> Column:
    return F.rand(seed) < p


def geometric(seed: int, p: float) -> Column:
    """Failures before the first success."""
    return F.floor(F.log(1 - F.rand(seed)) / F.log(F.lit(1 - p))).cast("long")


def _of_one_draw(seed: int, f: Callable[[Column], Column]) -> Column:
    """``f`` of a single uniform draw, however often it is used."""
    return F.transform(F.array(F.rand(seed)), f)[0]


def discrete(seed: int, weights: list[float]) -> Column:
    """Index drawn in proportion to weights."""
    total = sum(weights)

    def pick(draw: Column) -> Column:
        out, so_far = F.lit(len(weights) - 1), total
        for i in range(len(weights) - 2, -1, -1):
            so_far -= weights[i + 1]
            out = F.when(draw < so_far / total, i).otherwise(out)
        return out

    return _of_one_draw(seed, pick)


def binomial(seed: int, n: int, p: float) -> Column:
    return sum(((F.rand(seed + 7919 * i) < p).cast("int") for i in range(n)), F.lit(0))


def gamma(seed: int, shape: int, scale: float = 1.0) -> Column:
    """Of an integer shape: a sum of exponential draws."""
    return sum((exponential(seed + 7919 * i, 1.0) for i in range(shape)), F.lit(0.0)) * scale


def students_t(seed: int, freedom: int) -> Column:
    square = sum((F.pow(F.randn(seed + 7919 * (i + 1)), 2) for i in range(freedom)), F.lit(0.0))
    return F.randn(seed) / F.sqrt(square / freedom)


def piecewise_linear(seed: int, points: list[float], densities: list[float]) -> Column:
    """Draws whose density runs linearly between the given densities."""
    parts = list(zip(points, points[1:], densities, densities[1:], strict=False))
    areas = [(b - a) * (u + v) / 2 for a, b, u, v in parts]
    total = sum(areas)

    def pick(draw: Column) -> Column:
        out, so_far = F.lit(float(points[-1])), total
        for (a, b, u, v), area in reversed(list(zip(parts, areas, strict=True))):
            so_far -= area
            if not area:
                continue
            t, slope = draw * total - so_far, (v - u) / (b - a)
            root = F.sqrt(F.greatest(F.lit(0.0), t * (2 * slope) + u * u))
            out = F.when(t <= area, (t / u if slope == 0 else (root - u) / slope) + a).otherwise(out)
        return out

    # Later parts are tested last: the first whose share reaches the draw is taken.
    return _of_one_draw(seed, pick)


ROUNDING = {"floor": F.floor, "ceil": F.ceil, "trunc": lambda x: x.cast("long"), "round": F.round}
