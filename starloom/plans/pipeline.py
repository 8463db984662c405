"""Whole plans: group catalogues of snapshots, and links, flags and graphs over all of them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions import cosmology as cosmo
from starloom.operators import graph, links, phase, properties, spatial
from starloom.operators.components import written
from starloom.sources.params import Params, Snapshot, snapshot
from starloom.sources.tables import species, with_flow


@dataclass(frozen=True)
class Catalogue:
    members: DataFrame
    groups: DataFrame
    sub_members: DataFrame | None = None
    sub_groups: DataFrame | None = None


def find_groups(parts: DataFrame, box: spatial.Box, linking: float, velocity_factor: float, softening: float, factor: float, g: float = 1.0, least: int = 10, periodic: bool = True, start: float = 10.0, end: float = 0.8, decrement: float = 0.01, sub_linking: float | None = None, sub_velocity_factor: float | None = None, baryon_linking: float | None = None, sub_baryon_linking: float | None = None, hubble: float = 0.0) -> Catalogue:
    """Friends of friends, refined in phase space until bound; with sub_linking the same inside each group.

    Velocities get the expansion's part, hubble * (x - L / 2), of the positions as they are given. With baryon_linking, groups of dark matter
    (part_type 1) and of all other species are joined where they touch; phase space then takes the longer linking length. Subgroups have
    velocity_factor * sqrt(linking / sub_linking) unless they are given one of their own. The members' and the catalogue's velocities include the expansion.
    """
    cols = ["pid", "x", "y", "z", "vx", "vy", "vz", "mass", "part_type"]
    p = with_flow(parts.select(*cols), hubble, box)
    if baryon_linking is None:
        found = spatial.friends(p, linking, box, periodic)
    else:
        joint = spatial.joint_groups(p.where("part_type = 1"), p.where("part_type <> 1"), linking, baryon_linking, box, periodic)
        found = p.join(joint, "pid")
    spatial_groups = written(spatial.at_least(found, least))
    whole = properties.wrapped(spatial_groups, box) if periodic else spatial_groups

    def refined(found: DataFrame, length: float, v: float) -> tuple[DataFrame, DataFrame]:
        # Tables: refinement is the costly step, and properties read its members several times.
        r = written(phase.refine(found, length, v, softening, factor, start, end, decrement, least))
        members = written(found.drop("halo_id").join(r.select("pid", "halo_id", "host_id", "exit_alpha"), "pid"))
        exits = r.groupBy("halo_id").agg(F.first("host_id").alias("host_id"), F.first("exit_alpha").alias("exit_alpha"))
        return members, properties.catalogue(members, softening, factor, g).join(exits, "halo_id")

    members, groups = refined(whole, max(linking, baryon_linking or 0.0), velocity_factor)
    if sub_linking is None:
        return Catalogue(members, groups)
    subs = spatial.friends(members.drop("host_id", "exit_alpha").withColumnRenamed("halo_id", "parent"), sub_linking, box, False, "parent").drop("parent")
    sub_factor = sub_velocity_factor if sub_velocity_factor is not None else velocity_factor * math.sqrt(linking / sub_linking)
    sub_members, sub_groups = refined(spatial.at_least(subs, least), max(sub_linking, sub_baryon_linking or 0.0), sub_factor)
    return Catalogue(members, groups, sub_members, sub_groups)


#: (G in km^3 / solar mass / s^2) to the potential term in (km/s)^2 per 10^10 solar masses and megaparsec. Fixed values of the units.
MASS_UNIT, MPC_KM = 1e10, 3.086e19


def find_in_snapshot(parts: DataFrame, p: Params, redshift: float, box: tuple[float, float, float], snap: Snapshot | None = None) -> Catalogue:
    """find_groups() of one snapshot's particles with all lengths and factors from a parameter file.

    Species that aren't read are left out; their counts come from the table unless snap has them.
    """
    read = species(parts, int(p.simulation["ignored_species_lim"]), bool(p.flags["DMO"]))
    if snap is None:
        counts = {int(r["part_type"]): r["n"] for r in read.groupBy("part_type").agg(F.count("*").alias("n")).collect()}  # a row a species
        snap = snapshot(p, redshift, box, counts)
    other = {t: length for t, length in snap.linking.items() if t != 1}
    q = p.parameters
    subs = bool(p.flags["find_subs"])
    baryons = max(other.values()) if other else None
    sub_baryons = max((length for t, length in snap.sub_linking.items() if t != 1), default=None)
    return find_groups(
        read, snap.box, snap.linking[1], snap.velocity_factor, snap.softening, cosmo.G_KM * (1 + redshift) * MASS_UNIT / MPC_KM, cosmo.G_KM, int(q["part_threshold"]),
        bool(p.simulation["periodic"]), float(q["ini_alpha_v"]), float(q["min_alpha_v"]), float(q["decrement"]),
        snap.sub_linking[1] if subs else None, snap.sub_velocity_factor if subs else None, baryons, sub_baryons if subs else None, cosmo.hubble(redshift, p.cosmology),
    )


@dataclass(frozen=True)
class History:
    progenitors: DataFrame
    descendants: DataFrame
    flags: DataFrame
    cleaned: DataFrame
    nodes: DataFrame
    edges: DataFrame


def trace(members: DataFrame, groups: DataFrame, threshold: int = 10) -> History:
    """Links of all snapshots, flags over time, cleaned links and merger graphs; groups(snap_ord, halo_id, npart, real)."""
    prog, desc = links.progenitors(members, threshold), links.descendants(members, threshold)
    flags = graph.temporal_flags(groups, prog)
    nodes = graph.numbered(graph.rooted(graph.graphs(groups, prog, desc)))
    return History(prog, desc, flags, graph.cleaned_progenitors(prog, flags), nodes, graph.graph_edges(nodes, prog))
