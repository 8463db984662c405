"""A flat universe of matter, radiation (photons and three massless neutrinos) and a cosmological constant."""

from __future__ import annotations

import math

import numpy as np

# Physical constants (CODATA / IAU).
G_SI = 6.6743e-11
C_SI = 299_792_458.0
K_B = 1.380649e-23
HBAR = 1.054571817e-34
SUN_KG = 1.988409870698051e30
MPC_KM = 3.085677581491367e19
YEAR_S = 365.25 * 86400
G_KM = G_SI * SUN_KG / 1e9
NEUTRINOS = 3.04


def radiation(c: dict) -> float:
    """Today's radiation as a share of the critical density."""
    t = c.get("Tcmb0", 0.0)
    if not t:
        return 0.0
    photons = math.pi**2 / 15 * (K_B * t) ** 4 / (HBAR * C_SI) ** 3 / C_SI**2
    critical = 3 * (c["H0"] / MPC_KM) ** 2 / (8 * math.pi * G_SI)
    return photons / critical * (1 + NEUTRINOS * 7 / 8 * (4 / 11) ** (4 / 3))


def expansion(z, c: dict):
    """H(z) / H0."""
    r = radiation(c)
    return np.sqrt(r * (1 + z) ** 4 + c["Om0"] * (1 + z) ** 3 + 1 - r - c["Om0"])


def hubble(z: float, c: dict) -> float:
    """H(z) in km/s/Mpc."""
    return float(c["H0"] * expansion(z, c))


def critical_density(z: float, c: dict) -> float:
    """Solar masses per cubic km."""
    return 3 * (hubble(z, c) / MPC_KM) ** 2 / (8 * math.pi * G_KM)


def matter_share(z: float, c: dict) -> float:
    return float(c["Om0"] * (1 + z) ** 3 / expansion(z, c) ** 2)


def mean_density(z: float, c: dict) -> float:
    return matter_share(z, c) * critical_density(z, c)


def age(z: float, c: dict, steps: int = 20_001) -> float:
    """Age in Gyr: the integral of da / (a H(a)), by Simpson's rule in sqrt(a)."""
    s = np.linspace(0, math.sqrt(1 / (1 + z)), steps)
    with np.errstate(divide="ignore", invalid="ignore"):
        y = 2 / (s * expansion(1 / s**2 - 1, c))
    y[0] = 0.0 if radiation(c) == 0 else 0.0
    h = s[1] - s[0]
    total = h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    return total / (c["H0"] / MPC_KM) / YEAR_S / 1e9


def per_gyr(speed: float) -> float:
    """km/s in Mpc/Gyr."""
    return speed / MPC_KM * YEAR_S * 1e9
