"""Native snapshot files: HDF5 with a group for each species, read through a Python data source where h5py is installed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "snap_ord int, pid long, part_type int, x double, y double, z double, vx double, vy double, vz double, mass double, int_energy double"
ROWS = 500_000


class SnapshotSource(DataSource):
    """spark.read.format("snapshot_hdf5").option("snap_ord", 3).load(path); a slice of a species is a partition."""

    @classmethod
    def name(cls) -> str:
        return "snapshot_hdf5"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return SnapshotReader(self.options)


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.snap = options["path"], int(options.get("snap_ord", 0))

    def partitions(self) -> list[InputPartition]:
        import h5py

        out = []
        with h5py.File(self.path, "r") as f:
            for t in (0, 1, 4, 5):
                if f"PartType{t}" in f:
                    n = f[f"PartType{t}/ParticleIDs"].shape[0]
                    out += [InputPartition((t, a, min(a + ROWS, n))) for a in range(0, n, ROWS)]
        return out

    def read(self, partition: InputPartition) -> Iterator:
        import h5py
        import numpy as np
        import pyarrow as pa

        t, a, b = partition.value
        with h5py.File(self.path, "r") as f:
            g = f[f"PartType{t}"]
            pos, vel = g["Coordinates"][a:b], g["Velocities"][a:b]
            energy = g["InternalEnergies"][a:b] if t == 0 else np.zeros(b - a)
            columns = [np.full(b - a, self.snap, np.int32), g["ParticleIDs"][a:b].astype(np.int64), np.full(b - a, t, np.int32), *pos.T, *vel.T, g["Masses"][a:b], energy]
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.float64()] * 8]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def header(path: str) -> dict:
    """Box sides, particle counts by species and redshift of a snapshot file."""
    import h5py

    with h5py.File(path, "r") as f:
        h = f["Header"].attrs
        box = list(map(float, getattr(h["BoxSize"], "__iter__", lambda: iter([h["BoxSize"]] * 3))()))
        return {"box": box * 3 if len(box) == 1 else box, "counts": dict(enumerate(map(int, h["NumPart_Total"]))), "redshift": float(getattr(h["Redshift"], "item", lambda: h["Redshift"])())}


def read_snapshot(spark: SparkSession, path: str, snap_ord: int) -> DataFrame:
    spark.dataSource.register(SnapshotSource)
    return spark.read.format("snapshot_hdf5").option("snap_ord", snap_ord).load(path)
