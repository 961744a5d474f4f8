"""Small dense tensors as array columns (row-major) with shapes known when the plan is built."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def elementwise(a: Column, b: Column | float, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` of two arrays, or of an array and a number."""
    if isinstance(b, int | float):
        return F.transform(a, lambda x: op(x, F.lit(b)))
    return F.zip_with(a, b, op)


def add(a: Column, b: Column | float) -> Column:
    return elementwise(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column | float) -> Column:
    return elementwise(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column | float) -> Column:
    """Element-wise; the same as ``hadamard``."""
    return elementwise(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column | float) -> Column:
    return elementwise(a, b, lambda x, y: x / y)


def maximum(a: Column, b: Column | float) -> Column:
    return elementwise(a, b, lambda x, y: F.greatest(x, y))


def minimum(a: Column, b: Column | float) -> Column:
    return elementwise(a, b, lambda x, y: F.least(x, y))


hadamard = multiply


def outer(a: Column, b: Column) -> Column:
    """Tensor product, flattened."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def power(a: Column, n: int) -> Column:
    """Tensor product of ``n`` copies."""
    out = a
    for _ in range(n - 1):
        out = outer(out, a)
    return out


def scale_along(t: Column, v: Column, shape: Sequence[int], dim: int) -> Column:
    """t[..., i, ...] * v[i] along dimension ``dim``."""
    stride, n = prod(shape[dim + 1 :]), shape[dim]
    return F.transform(t, lambda x, k: x * F.get(v, (F.floor(k / F.lit(stride)) % n).cast("int")))


def contract(t: Column, v: Column, shape: Sequence[int], dim: int) -> Column:
    """Sum over dimension ``dim`` of t[..., i, ...] * v[i]."""
    stride, n = prod(shape[dim + 1 :]), shape[dim]
    places = F.sequence(F.lit(0), F.lit(prod(shape) // n - 1))

    def at(p: Column) -> Column:
        base = (F.floor(p / F.lit(stride)) * (stride * n) + p % stride).cast("int")
        out = F.lit(ZERO)
        for i in range(n):
            out = out + F.get(t, base + i * stride) * F.get(v, F.lit(i))
        return out

    return F.transform(places, at)


def apply_matrix(t: Column, matrix: Column, shape: Sequence[int], dim: int) -> Column:
    """out[..., i, ...] = sum over a of matrix[i, a] * t[..., a, ...] (row-major square matrix)."""
    stride, n = prod(shape[dim + 1 :]), shape[dim]

    def at(k: Column) -> Column:
        i = (F.floor(k / F.lit(stride)) % n).cast("int")
        base = k - i * stride
        out = F.lit(ZERO)
        for a in range(n):
            out = out + F.get(matrix, i * n + a) * F.get(t, base + a * stride)
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(prod(shape) - 1)), at)


def matmul(a: Column, b: Column, rows: int, inner: int, columns: int) -> Column:
    """Row-major product of a (rows x inner) and b (inner x columns)."""

    def at(k: Column) -> Column:
        i, j = F.floor(k / F.lit(columns)).cast("int"), (k % columns).cast("int")
        out = F.lit(ZERO)
        for m in range(inner):
            out = out + F.get(a, i * inner + m) * F.get(b, j + m * columns)
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), at)


def cartesian(v: Column, rank: int) -> Column:
    """All rank-tuples of the entries of ``v``, the last entry varying fastest."""

    def longer(tuples: Column) -> Column:
        return F.flatten(F.transform(tuples, lambda t: F.transform(v, lambda x: F.concat(t, F.array(x)))))

    out = F.transform(v, lambda x: F.array(x))
    for _ in range(rank - 1):
        out = longer(out)
    return out


def fold_pairs(a: Column, b: Column, start: Column, op: Callable[[Column, Column, Column], Column]) -> Column:
    """Folds ``op(so far, x, y)`` over pairs: distances and the like."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.aggregate(pairs, start, lambda acc, p: op(acc, p["x"], p["y"]))


def dot(a: Column, b: Column) -> Column:
    return fold_pairs(a, b, F.lit(ZERO), lambda acc, x, y: acc + x * y)


def squared_distance(a: Column, b: Column) -> Column:
    return fold_pairs(a, b, F.lit(ZERO), lambda acc, x, y: acc + (x - y) * (x - y))


def close(a: Column, b: Column, eps: float = 1e-4) -> Column:
    """Every pair differs by ``eps`` at most."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= eps), lambda x: x)


def equal(a: Column, b: Column) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)


def fill(n: int, value: float) -> Column:
    return F.array_repeat(F.lit(value), n)


def generate(n: int, f: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)


def slice_shaped(t: Column, shape: Sequence[int], start: Sequence[int], stop: Sequence[int], step: Sequence[int]) -> Column:
    """Entries of a box of indices, row-major; a negative stop counts from the end."""
    ends = [s + n + 1 if s < 0 else s for s, n in zip(stop, shape, strict=True)]
    places = [0]
    for n, a, b, k in zip(shape, start, ends, step, strict=True):
        places = [p * n + i for p in places for i in range(a, b, k)]
    return F.array(*(F.get(t, F.lit(p)) for p in places))


def indexed(t: Column, shape: Sequence[int]) -> Column:
    """Array of structs (index array, value): the long form, to explode."""
    from .geometry import multi_index

    return F.transform(t, lambda x, k: F.struct(F.array(*multi_index(k, shape)).alias("index"), x.alias("value")))
