"""Versions of a staged table: the parts that make it up, named by one small file, so that they change in one step.

A watched table grows by parts, each with rows and side rows (leads, refused files, files taken, files that
replace older ones). A part counts once a version names it; until then no reader sees any of it. Compaction
writes the oldest parts together as a generation and publishes a version that names it in their place.
Versions are numbered files that are created and never changed; the highest complete one holds. What a
compaction has replaced stays until the next one, for readers that are still at work.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from gridloom.cluster import hadoop_path, path_exists

PART = "_batch"
STATE, GENERATIONS = "_state", "_generations"

# A side table of every part: each file that it took or refused, as the file was then.
FILES = "_files"

# Versions that stay for readers, and tries of a writer that meets others.
KEPT_VERSIONS, TRIES = 10, 50


@dataclass(frozen=True)
class Version:
    """Parts in the order in which they came, after a generation that holds all earlier ones."""

    number: int = 0
    generation: str | None = None
    parts: tuple[str, ...] = ()
    retired: tuple[str, ...] = ()

    def with_parts(self, parts: Sequence[str]) -> "Version":
        """The parts of one more batch; parts of the same batch, from an attempt that was repeated, go."""
        others = [p for p in self.parts if batch_of(p) != batch_of(parts[0])]
        return replace(self, parts=(*others, *parts))

    def foldable(self) -> tuple[str, ...]:
        """The parts that no repeated batch can replace, up to the first one that may be."""
        batches = [int(batch_of(p)) for p in self.parts if batch_of(p).isdigit()]
        newest = str(max(batches)) if batches else ""
        first = next((i for i, p in enumerate(self.parts) if batch_of(p) == newest), len(self.parts))
        return self.parts[:first]


def batch_of(part: str) -> str:
    """What stands before the attempt in the name of a part: the number of its batch, if it has one."""
    return part.split("-")[0]


def children(spark: SparkSession, folder: str) -> list[str]:
    if not path_exists(spark, folder):
        return []
    filesystem, location = hadoop_path(spark, folder)
    return sorted(status.getPath().getName() for status in filesystem.listStatus(location))


def current(spark: SparkSession, table: str) -> Version | None:
    """The version that holds; None for a table that has none and is just its files."""
    for name in reversed([n for n in children(spark, f"{table}/{STATE}") if n.endswith(".json")]):
        filesystem, location = hadoop_path(spark, f"{table}/{STATE}/{name}")
        stream = filesystem.open(location)
        try:
            held = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            continue  # not written to its end
        finally:
            stream.close()
        return Version(held["number"], held["generation"], tuple(held["parts"]), tuple(held["retired"]))
    return None


def commit(spark: SparkSession, table: str, change: Callable[[Version], Version]) -> Version:
    """Publish what ``change`` makes of the version that holds; again if another writer was first."""
    for _ in range(TRIES):
        before = current(spark, table) or Version()
        made = change(before)
        after = replace(made, number=before.number + 1)
        filesystem, location = hadoop_path(spark, f"{table}/{STATE}/{after.number:010}.json")
        try:
            stream = filesystem.create(location, False)
        except Exception:
            if not filesystem.exists(location):
                raise
            continue
        stream.write(bytearray(json.dumps(asdict(after)).encode()))
        stream.close()
        for name in children(spark, f"{table}/{STATE}")[:-KEPT_VERSIONS]:
            if name.endswith(".json") and int(name.split(".")[0]) < after.number - KEPT_VERSIONS:
                filesystem.delete(hadoop_path(spark, f"{table}/{STATE}/{name}")[1], False)
        return after
    raise RuntimeError(f"Other writers of '{table}' were always first.")


def parts_of(spark: SparkSession, table: str, version: Version, side: str | None = None) -> DataFrame | None:
    """Rows of the parts that a version names, or of one of their sides, with the part; None if there are none."""
    root = f"{table}/{side}" if side else table
    there = set(children(spark, root))
    wanted = [f"{root}/{PART}={p}" for p in version.parts if f"{PART}={p}" in there]
    if not wanted:
        return None
    # the part is text, whatever its characters
    rows = spark.read.option("basePath", root).parquet(*wanted)
    return rows.withColumn(PART, rows[PART].cast("string"))


def generation_of(spark: SparkSession, table: str, version: Version, side: str = "rows") -> DataFrame | None:
    place = f"{table}/{GENERATIONS}/{version.generation}/{side}"
    return spark.read.parquet(place) if version.generation and path_exists(spark, place) else None


def side_rows(spark: SparkSession, table: str, version: Version, side: str) -> DataFrame | None:
    """Side rows of a version, its generation's and its parts'."""
    found = [rows for rows in (generation_of(spark, table, version, side), parts_of(spark, table, version, side)) if rows is not None]
    if len(found) == 2:
        return found[0].unionByName(found[1], allowMissingColumns=True)
    return found[0] if found else None


def remove(spark: SparkSession, table: str, names: tuple[str, ...]) -> None:
    """Delete parts and generations that no version names any more, with their sides."""
    filesystem, root = hadoop_path(spark, table)
    sides = [n for n in children(spark, table) if n.startswith("_") and "=" not in n and n not in (STATE, GENERATIONS)]
    for name in names:
        for place in (f"{table}/{PART}={name}", f"{table}/{GENERATIONS}/{name}", *(f"{table}/{s}/{PART}={name}" for s in sides)):
            if path_exists(spark, place):
                filesystem.delete(hadoop_path(spark, place)[1], True)
