"""Parameter files and everything derived from them."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import yaml

from starloom.functions import cosmology as cosmo

SECTIONS = ("inputs", "flags", "parameters", "cosmology", "simulation")
#: Species that are never read.
DROPPED = (2, 3)


@dataclass(frozen=True)
class Params:
    """The sections of a parameter file over their defaults."""

    inputs: dict = field(default_factory=dict)
    flags: dict = field(default_factory=dict)
    parameters: dict = field(default_factory=dict)
    cosmology: dict = field(default_factory=dict)
    simulation: dict = field(default_factory=dict)


# The sections, keys and defaults of the parameter file.
DEFAULTS = {
    "inputs": {},
    "flags": {"DMO": 1, "find_subs": 0, "clean_real_flags": 0, "graphdirect": 0, "subgraphdirect": 0, "graph": 0, "subgraph": 0, "debug_mode": 0, "verbose": 1, "profile": 0},
    "parameters": {"part_threshold": 10, "ini_alpha_v": 10.0, "min_alpha_v": 0.8, "llcoeff": 0.2, "sub_llcoeff": 0.1, "decrement": 0.01, "N_cells": 16, "spatial_task_size": 100_000, "link_threshold": 10, "nthreads": -1},
    "cosmology": {"H0": 67.7, "h": 0.677, "Om0": 0.3, "Ob0": 0.05, "Tcmb0": 2.725},
    "simulation": {"comoving_DM_softening": 0.015625, "max_physical_DM_softening": 0.004222, "periodic": 1, "ignored_species_lim": 6, "data_type": "SWIFT", "zoom": 0},
}


def read_params(text_or_path: str) -> Params:
    """A parameter file, given by its path or its text."""
    if "\n" in text_or_path:
        found = yaml.safe_load(text_or_path) or {}
    else:
        with open(text_or_path, encoding="utf-8") as f:
            found = yaml.safe_load(f) or {}
    return Params(**{s: DEFAULTS[s] | (found.get(s) or {}) for s in SECTIONS})


@dataclass(frozen=True)
class Snapshot:
    """What operators need to know about one snapshot."""

    redshift: float
    box: tuple[float, float, float]
    counts: dict[int, int]
    scale: float
    softening: float
    mean_separation: dict[int, float]
    linking: dict[int, float]
    sub_linking: dict[int, float]
    mean_density: float
    velocity_factor: float
    sub_velocity_factor: float
    cells: int
    cell_width: float


def snapshot(p: Params, redshift: float, box: tuple[float, float, float], counts: dict[int, int]) -> Snapshot:
    """Scalars of a snapshot from its redshift, box sides and particle counts by species."""
    kept = {t: n for t, n in counts.items() if t not in DROPPED and t < p.simulation["ignored_species_lim"] and n > 0 and (t == 1 or not p.flags["DMO"])}
    a = 1 / (1 + redshift)
    soft = p.simulation["comoving_DM_softening"]
    if soft * a > p.simulation["max_physical_DM_softening"]:
        soft = p.simulation["max_physical_DM_softening"] / a
    volume = math.prod(box)
    baryons = sum(n for t, n in kept.items() if t != 1)
    separation = {t: (volume / (n if t == 1 else baryons)) ** (1 / 3) for t, n in kept.items()}
    linking = {t: p.parameters["llcoeff"] * s for t, s in separation.items()}
    sub = {t: p.parameters["sub_llcoeff"] * s for t, s in separation.items()}
    density = cosmo.mean_density(redshift, p.cosmology)
    factor = math.sqrt(cosmo.G_KM / 2) * (4 * math.pi * 200 * density / 3) ** (1 / 6) * 10 ** (10 / 3)
    ratio = math.sqrt(linking[1] / sub[1]) if 1 in linking else math.sqrt(p.parameters["llcoeff"] / p.parameters["sub_llcoeff"])
    cells = int(p.parameters["N_cells"])
    return Snapshot(redshift, box, kept, a, soft, separation, linking, sub, density, factor, factor * ratio, cells, min(box) / cells)
