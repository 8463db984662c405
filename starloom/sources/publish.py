"""Tables of a catalogue that change together or not at all.

Each table of a snapshot is first written to a folder of its own, which nobody looks into. When all are there, one small file, the next
version, says which folders every table of every snapshot has by now. Readers go by the highest version, so that they see all tables of a
snapshot from before or from after; what fails earlier leaves the versions alone, and its folders are removed. One program at a time
writes to a catalogue: of two, the one that comes second to a version is told so.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSIONS, DATA = "versions", "data"


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _at(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def version(spark: SparkSession, path: str) -> tuple[int, dict[str, dict[str, str]]]:
    """(number, folders): the current version of a catalogue; table to snapshot to folder. 0 and nothing for one that isn't there."""
    numbers = [int(n[:-5]) for n in _names(spark, f"{path}/{VERSIONS}") if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return 0, {}
    text = "\n".join(r["value"] for r in spark.read.text(f"{path}/{VERSIONS}/{max(numbers):08d}.json", wholetext=True).collect())
    return max(numbers), json.loads(text)


def _commit(spark: SparkSession, path: str, number: int, folders: dict) -> None:
    """Makes `number` the current version: written under another name, then renamed, which is one step."""
    fs, final = _at(spark, f"{path}/{VERSIONS}/{number:08d}.json")
    _, draft = _at(spark, f"{path}/{VERSIONS}/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(folders, indent=1, sort_keys=True).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"{path}: another program has written version {number}")


def publish(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], snap_ord: int | None = None) -> int:
    """Replaces these tables of a snapshot (of no snapshot, for tables of all of them) in one step; returns the version's number."""
    number, folders = version(spark, path)
    mine, key = f"{DATA}/{uuid.uuid4().hex}", "all" if snap_ord is None else str(snap_ord)
    try:
        for name, table in tables.items():
            t = table if snap_ord is None else table.withColumn("snap_ord", F.lit(snap_ord))
            t.write.option("compression", "zstd").parquet(f"{path}/{mine}/{name}")
            folders.setdefault(name, {})[key] = f"{mine}/{name}"
        _commit(spark, path, number + 1, folders)
    except BaseException:
        fs, at = _at(spark, f"{path}/{mine}")
        fs.delete(at, True)
        raise
    return number + 1


def table(spark: SparkSession, path: str, name: str, snaps: list[int] | None = None) -> DataFrame:
    """A table of the current version, of some snapshots or all."""
    _, folders = version(spark, path)
    keys = folders.get(name, {})
    at = [f"{path}/{f}" for k, f in sorted(keys.items()) if snaps is None or k in {str(s) for s in snaps}]
    if not at:
        raise ValueError(f"{path} has no table {name}" + (f" of snapshots {snaps}" if snaps else ""))
    return spark.read.parquet(*at)


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes versions but the current one and the folders it doesn't name, of which there must be no reader or writer left; says how many folders."""
    number, folders = version(spark, path)
    used = {f.split("/")[1] for per in folders.values() for f in per.values()}
    gone = [n for n in _names(spark, f"{path}/{DATA}") if n not in used]
    for n in gone:
        fs, at = _at(spark, f"{path}/{DATA}/{n}")
        fs.delete(at, True)
    for n in _names(spark, f"{path}/{VERSIONS}"):
        if n != f"{number:08d}.json":
            fs, at = _at(spark, f"{path}/{VERSIONS}/{n}")
            fs.delete(at, False)
    return len(gone)
