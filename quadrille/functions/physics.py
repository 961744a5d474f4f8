"""Equations as builders of column expressions.

An equation names its conserved fields and gives the conservative form of primitive values, the
Rusanov flux between two states and the largest wave speed.  Any object with these members works.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

State = Mapping[str, Column]


class Equation(Protocol):
    fields: Sequence[str]

    def conservative(self, primitive: State) -> dict[str, Column]: ...

    def flux(self, left: State, right: State, axis: int) -> dict[str, Column]: ...

    def speed(self, state: State, axis: int) -> Column: ...


class Advection:
    """One scalar carried along at a constant velocity (x, y, z); upwind flux."""

    fields = ("u",)

    def __init__(self, velocity: Sequence[float] = (1.0, 0.5, 0.0)):
        self.velocity = tuple(velocity)

    def conservative(self, primitive: State) -> dict[str, Column]:
        return {"u": primitive["u"]}

    def flux(self, left: State, right: State, axis: int) -> dict[str, Column]:
        v = self.velocity[axis]
        return {"u": (left["u"] if v >= 0 else right["u"]) * F.lit(v)}

    def speed(self, state: State, axis: int) -> Column:
        return F.lit(abs(self.velocity[axis]))


class Euler:
    """Compressible Euler equations of ``rank`` dimensions: rho, momenta, total energy."""

    def __init__(self, rank: int = 2, gamma: float = 1.4):
        self.rank, self.gamma = rank, gamma
        self.momenta = ("mx", "my", "mz")[:rank]
        self.velocities = ("vx", "vy", "vz")[:rank]
        self.fields = ("rho", *self.momenta, "e")

    def conservative(self, primitive: State) -> dict[str, Column]:
        """From rho, vx, vy[, vz], p."""
        rho = primitive["rho"]
        squared = sum((primitive[v] * primitive[v] for v in self.velocities), F.lit(0.0))
        out = {"rho": rho}
        out |= {m: rho * primitive[v] for m, v in zip(self.momenta, self.velocities, strict=True)}
        return out | {"e": primitive["p"] / (self.gamma - 1) + rho * squared * 0.5}

    def pressure(self, state: State) -> Column:
        kinetic = sum((state[m] * state[m] for m in self.momenta), F.lit(0.0)) * 0.5 / state["rho"]
        return (state["e"] - kinetic) * (self.gamma - 1)

    def primitive(self, state: State) -> dict[str, Column]:
        out = {"rho": state["rho"], "p": self.pressure(state)}
        return out | {v: state[m] / state["rho"] for m, v in zip(self.momenta, self.velocities, strict=True)}

    def speed(self, state: State, axis: int) -> Column:
        sound = F.sqrt(self.pressure(state) * self.gamma / state["rho"])
        return F.abs(state[self.momenta[axis]] / state["rho"]) + sound

    def physical_flux(self, state: State, axis: int) -> dict[str, Column]:
        along = state[self.momenta[axis]] / state["rho"]
        p = self.pressure(state)
        out = {"rho": state[self.momenta[axis]]}
        out |= {m: state[m] * along + (p if i == axis else 0.0) for i, m in enumerate(self.momenta)}
        return out | {"e": along * (state["e"] + p)}

    def flux(self, left: State, right: State, axis: int) -> dict[str, Column]:
        top = F.greatest(self.speed(left, axis), self.speed(right, axis))
        fl, fr = self.physical_flux(left, axis), self.physical_flux(right, axis)
        return {f: (fl[f] + fr[f] - top * (right[f] - left[f])) * 0.5 for f in self.fields}


EQUATIONS = {"advection": Advection, "euler": Euler}


def gaussian(coords: Sequence[Column], center: Sequence[float], width: float, amplitude: float = 1.0) -> Column:
    """amplitude * exp(-r**2 / width)."""
    r2 = sum(((c - m) * (c - m) for c, m in zip(coords, center, strict=True)), F.lit(0.0))
    return F.exp(-r2 / F.lit(width)) * amplitude


def acoustic_pulse(coords: Sequence[Column], lengths: Sequence[float], amplitude: float = 10.0, width: float = 0.01) -> dict[str, Column]:
    """Primitive state of a pressure bump at rest in the middle of the box."""
    area = 1.0
    for length in lengths:
        area *= length
    g = gaussian(coords, [length / 2 for length in lengths], width * area ** (2 / len(lengths)), amplitude)
    rest = {v: F.lit(0.0) for v in ("vx", "vy", "vz")[: len(coords)]}
    return {"rho": F.lit(0.5) + g * 0.2, "p": F.lit(1.0) + g, **rest}


def sine_waves(x: Column, y: Column, t: float = 0.0) -> list[Column]:
    """Four components that advection carries along exactly."""
    turn = F.lit(2 * 3.141592653589793)
    return [F.sin(turn * (x + y - 2 * t)), F.sin(turn * (y - t)), F.lit(1.0), F.lit(1.0)]


def quadrants(x: Column, y: Column, split: float, states: Sequence[Mapping[str, float]]) -> dict[str, Column]:
    """Piecewise constant: states for (low, low), (high, low), (low, high), (high, high)."""
    which = (x >= split).cast("int") + (y >= split).cast("int") * 2
    return {k: F.element_at(F.array(*(F.lit(float(s[k])) for s in states)), which + 1) for k in states[0]}
