"""Lagrange basis and Gauss-Legendre tables for discontinuous-Galerkin cells.

Tables are tiny and known when a plan is built: numpy makes them here, expressions carry them as
literals.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache
def gauss(order: int, start: float = 0.0, end: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights on [start, end], ascending."""
    if not 1 <= order <= 8:
        raise ValueError("orders 1 to 8")
    x, w = np.polynomial.legendre.leggauss(order)
    half = (end - start) / 2
    return start + half * (x + 1), w * half


def lagrange(nodes: np.ndarray, i: int, x: float) -> float:
    """Value of basis polynomial ``i``."""
    return float(np.prod([(x - n) / (nodes[i] - n) for k, n in enumerate(nodes) if k != i]))


def lagrange_derivative(nodes: np.ndarray, i: int, x: float) -> float:
    total = 0.0
    for k in range(len(nodes)):
        if k != i:
            rest = [(x - n) / (nodes[i] - n) for m, n in enumerate(nodes) if m not in (i, k)]
            total += float(np.prod(rest)) / (nodes[i] - nodes[k])
    return total


def barycentric_weights(nodes: np.ndarray) -> np.ndarray:
    return np.array([1 / np.prod([nodes[i] - n for k, n in enumerate(nodes) if k != i]) for i in range(len(nodes))])


def barycentric(nodes: np.ndarray, x: float) -> np.ndarray:
    """All basis values at x; at a node exactly one is 1."""
    at = np.flatnonzero(np.isclose(nodes, x, rtol=0, atol=1e-14))
    if len(at):
        return np.eye(len(nodes))[at[0]]
    terms = barycentric_weights(nodes) / (x - nodes)
    return terms / terms.sum()


def barycentric_derivative(nodes: np.ndarray, x: float) -> np.ndarray:
    """All basis derivatives at x."""
    return np.array([lagrange_derivative(nodes, i, x) for i in range(len(nodes))])


@lru_cache
def derivative_matrix(order: int) -> np.ndarray:
    """D[i, j]: derivative of polynomial i at node j."""
    nodes, _ = gauss(order)
    return np.array([[lagrange_derivative(nodes, i, x) for x in nodes] for i in range(order)])


@lru_cache
def face_values(order: int) -> tuple[np.ndarray, np.ndarray]:
    """Basis at 0 and at 1."""
    nodes, _ = gauss(order)
    return barycentric(nodes, 0.0), barycentric(nodes, 1.0)


def tensor_points(order: int, rank: int) -> np.ndarray:
    nodes, _ = gauss(order)
    return np.stack([g.ravel() for g in np.meshgrid(*[nodes] * rank, indexing="ij")], axis=1)


def tensor_weights(order: int, rank: int) -> np.ndarray:
    """Diagonal of the mass matrix of a cell of ``rank`` dimensions."""
    _, w = gauss(order)
    out = w
    for _ in range(rank - 1):
        out = np.multiply.outer(out, w).ravel()
    return out


def inverse_mass(order: int, rank: int) -> np.ndarray:
    return 1 / tensor_weights(order, rank)


def evaluation_row(order: int, point: np.ndarray) -> np.ndarray:
    """Weights of all nodes (row-major) of the interpolant at a point of the unit cube."""
    nodes, _ = gauss(order)
    out = np.ones(1)
    for x in point:
        out = np.multiply.outer(out, barycentric(nodes, float(x))).ravel()
    return out


@lru_cache
def prolongation(order: int, rank: int = 2) -> np.ndarray:
    """[child, node, parent node]: child nodes as values of the parent's interpolant."""
    points = tensor_points(order, rank)
    return np.array(
        [
            [evaluation_row(order, 0.5 * p + 0.5 * np.array([(c >> k) & 1 for k in range(rank)])) for p in points]
            for c in range(1 << rank)
        ]
    )


@lru_cache
def restriction(order: int, rank: int = 2) -> list[tuple[int, np.ndarray]]:
    """For each parent node: the child that holds it, and the weights of that child's nodes."""
    out = []
    for p in tensor_points(order, rank):
        child = sum(int(x >= 0.5) << k for k, x in enumerate(p))
        out.append((child, evaluation_row(order, np.array([2 * x - (x >= 0.5) for x in p]))))
    return out


def literal(values: np.ndarray) -> Column:
    """A table as an array literal."""
    return F.array(*(F.lit(float(v)) for v in np.asarray(values).ravel()))
