"""Run settings, from keywords or from plain ``key: value`` text."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """What a run needs besides its tables."""

    order: int = 2
    dim: int = 2
    cells: int = 8
    halo: int = 1
    depth: int = 7
    equation: str = "advection"
    integrator: str = "ssprk2"
    cfl: float = 0.3
    dt: float = 0.01
    end_time: float = 1.0
    initial_level: int = 4
    regrid_every: int = 5
    output_every: int = 20
    refine_above: float = 0.05
    coarsen_below: float = 0.01
    min_level: int = 1
    max_level: int = 6


def parse(text: str, base: Settings | None = None) -> Settings:
    """Reads known keys of ``key: value`` lines; blanks before a key, comments and other lines are left out."""
    types = {f.name: type(getattr(Settings, f.name)) for f in fields(Settings)}
    found = {}
    for line in text.splitlines():
        key, colon, value = line.partition("#")[0].strip().partition(":")
        if colon and key in types and value.strip():
            found[key] = types[key](value.strip().strip("\"'"))
    return replace(base or Settings(), **found)
