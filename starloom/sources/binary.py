"""Snapshots in length-framed binary files, one or several to a snapshot, as a Python data source.

A file is a row of blocks, each between two copies of its length in bytes: a header of 256 bytes, then places, velocities and ids of all
particles by species, masses of species whose mass isn't in the header, and inner energies of species 0; in the second format a block with
a name of four letters comes before each. Numbers of either byte order and either width are read. A slice of a species of a file is
a partition, and only the bytes of the blocks that its columns need are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The header's layout and the order and names of the blocks.
HEAD = "6I6d2d2i6I2i4d2i6I"
HEAD_BYTES = 256
ORDER = ("POS", "VEL", "ID", "MASS", "U")
AXES = {"POS": ("x", "y", "z"), "VEL": ("vx", "vy", "vz"), "ID": ("pid",), "MASS": ("mass",), "U": ("int_energy",)}
KINDS = {"snap_ord": "int", "pid": "long", "part_type": "int", "x": "double", "y": "double", "z": "double", "vx": "double", "vy": "double", "vz": "double", "mass": "double", "int_energy": "double"}
ROWS = 500_000


@dataclass(frozen=True)
class Header:
    """One file's header; counts are the file's, totals the snapshot's."""

    counts: tuple[int, ...]
    masses: tuple[float, ...]
    scale: float
    redshift: float
    totals: tuple[int, ...]
    files: int
    box: float
    matter: float
    dark_energy: float
    h: float


@dataclass(frozen=True)
class Layout:
    """Where a file's blocks lie: name to (first byte, bytes)."""

    order: str
    header: Header
    blocks: dict[str, tuple[int, int]]


def opened(path: str):
    """(filesystem, path) of a local path or of any address that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The files of a snapshot: the path itself, or <path>.0, <path>.1, ..., or all of a folder in the order of their names' numbers."""
    from pyarrow import fs

    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.Directory:
        number = lambda n: (int(n.rsplit(".", 1)[-1]) if n.rsplit(".", 1)[-1].isdigit() else -1, n)
        names = [f.base_name for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        return [f"{path.rstrip('/')}/{n}" for n in sorted(names, key=number)]
    out = []
    while system.get_file_info(f"{at}.{len(out)}").type == fs.FileType.File:
        out.append(f"{path}.{len(out)}")
    if not out:
        raise FileNotFoundError(path)
    return out


def layout(path: str) -> Layout:
    """A file's header and blocks, found by reading the lengths around them."""
    system, at = opened(path)
    with system.open_input_file(at) as f:
        size = f.size()
        first = f.read_at(4, 0)
        order = "<" if struct.unpack("<I", first)[0] in (HEAD_BYTES, 8) else ">"
        named = struct.unpack(order + "I", first)[0] == 8
        place, found, names = 0, {}, []

        def block(place: int) -> tuple[int, int]:
            n = struct.unpack(order + "I", f.read_at(4, place))[0]
            if place + 8 + n > size or struct.unpack(order + "I", f.read_at(4, place + 4 + n))[0] != n:
                raise ValueError(f"{path}: no block of {n} bytes at byte {place}")
            return place + 4, n

        name = "HEAD"
        if named:
            name_at, n = block(place)
            name, place = f.read_at(4, name_at).decode().strip(), name_at + n + 4
        start, n = block(place)
        if name != "HEAD" or n != HEAD_BYTES:
            raise ValueError(f"{path}: begins with a block {name} of {n} bytes")
        v = struct.unpack(order + HEAD, f.read_at(struct.calcsize(order + HEAD), start))
        header = Header(v[0:6], v[6:12], v[12], v[13], tuple(lo + (hi << 32) for lo, hi in zip(v[16:22], v[30:36], strict=True)), v[23], v[24], v[25], v[26], v[27])
        place = start + n + 4
        rest = [b for b in ORDER if (b != "MASS" or any(c and not m for c, m in zip(header.counts, header.masses, strict=True))) and (b != "U" or header.counts[0])]
        while place < size and (named or rest):
            if named:
                name_at, n = block(place)
                name, place = f.read_at(4, name_at).decode().strip(), name_at + n + 4
            else:
                name = rest.pop(0)
            start, n = block(place)
            found[name] = (start, n)
            names.append(name)
            place = start + n + 4
    return Layout(order, header, found)


def header(path: str) -> dict:
    """Box sides, counts by species, redshift and the other scalars of a snapshot; its files must have all of its particles."""
    heads = [layout(p).header for p in files_of(path)]
    counts = [sum(h.counts[t] for h in heads) for t in range(6)]
    first = heads[0]
    if len(heads) != max(1, first.files) or (any(first.totals) and tuple(counts) != first.totals):
        raise ValueError(f"{path}: {counts} particles in {len(heads)} files, but the header says {list(first.totals)} in {first.files}")
    return {"box": [first.box] * 3, "counts": dict(enumerate(counts)), "redshift": first.redshift, "scale": first.scale, "h": first.h, "Om0": first.matter, "masses": dict(enumerate(first.masses))}


class BinarySource(DataSource):
    """spark.read.format("snapshot_binary").option("snap_ord", 3).option("columns", "pid,x").load(path); all columns by default."""

    @classmethod
    def name(cls) -> str:
        return "snapshot_binary"

    def wanted(self) -> list[str]:
        asked = self.options.get("columns")
        return [c.strip() for c in asked.split(",")] if asked else list(KINDS)

    def schema(self) -> str:
        return ", ".join(f"{c} {KINDS[c]}" for c in self.wanted())

    def reader(self, schema):
        return BinaryReader(self.options, self.wanted())


class BinaryReader(DataSourceReader):
    def __init__(self, options: dict, wanted: list[str]):
        self.path, self.snap, self.wanted = options["path"], int(options.get("snap_ord", 0)), wanted
        self.rows = int(options.get("rows", ROWS))

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in files_of(self.path):
            counts = layout(p).header.counts
            out += [InputPartition((p, t, a, min(a + self.rows, n))) for t, n in enumerate(counts) for a in range(0, n, self.rows)]
        return out

    def read(self, partition: InputPartition) -> Iterator:
        import numpy as np
        import pyarrow as pa

        path, t, a, b = partition.value
        where = layout(path)
        h, values = where.header, {}
        system, at = opened(path)
        with system.open_input_file(at) as f:

            def rows(name: str, before: int, total: int, wide: int) -> np.ndarray:
                """Rows a to b of this species in a block of `total` rows, `before` of them of earlier species."""
                start, size = where.blocks[name]
                item = size // (total * wide)
                if item not in (4, 8) or item * total * wide != size:
                    raise ValueError(f"{path}: block {name} has {size} bytes for {total} rows")
                kind = np.dtype(f"{where.order}{'u' if name == 'ID' else 'f'}{item}")
                return np.frombuffer(f.read_at((b - a) * wide * item, start + (before + a) * wide * item), kind).reshape(b - a, wide)

            for name, columns in AXES.items():
                if not set(columns) & set(self.wanted):
                    continue
                own = [n if name not in ("MASS", "U") or (name == "MASS" and not m) or (name == "U" and k == 0) else 0 for k, (n, m) in enumerate(zip(h.counts, h.masses, strict=True))]
                if own[t]:
                    values |= dict(zip(columns, rows(name, sum(own[:t]), sum(own), len(columns)).T, strict=True))
                else:
                    values |= {c: np.full(b - a, h.masses[t] if name == "MASS" else 0.0) for c in columns}
        values |= {"snap_ord": np.full(b - a, self.snap), "part_type": np.full(b - a, t)}
        arrow = {"int": np.int32, "long": np.int64, "double": np.float64}
        yield pa.RecordBatch.from_arrays([pa.array(values[c].astype(arrow[KINDS[c]])) for c in self.wanted], names=self.wanted)


def read_binary(spark: SparkSession, path: str, snap_ord: int = 0, columns: tuple[str, ...] | None = None, rows: int = ROWS) -> DataFrame:
    """The particles of a snapshot (a file, a folder of files, or the name before .0, .1, ...)."""
    spark.dataSource.register(BinarySource)
    reader = spark.read.format("snapshot_binary").option("snap_ord", snap_ord).option("rows", rows)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)
