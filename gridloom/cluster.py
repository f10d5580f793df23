"""Session and storage helpers: a local test session, the shared scratch folder, Hadoop paths."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Writers at work, by application, and the limit that was set before the first of them.
_IN_PIECES: dict[str, tuple[int, str | None]] = {}
_LOCK = threading.Lock()

# The folder a local session without spark.checkpoint.dir uses, by application.
_LOCAL_ROOTS: dict[str, str] = {}


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark. A cluster brings its own session and settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def compiled_in_pieces(spark: SparkSession) -> Iterator[None]:
    """While rows with many expressions are written, keep generated methods small enough for the JVM.

    The JVM interprets methods over 8000 bytes. Above this limit Spark generates one method per
    expression instead of one for the whole stage. The session's own limit is put back when the last of
    several writers that run at a time is done.
    """
    key, jvm_limit = "spark.sql.codegen.hugeMethodLimit", 8000
    session = spark.sparkContext.applicationId
    with _LOCK:
        writers, previous = _IN_PIECES.get(session, (0, spark.conf.get(key, None)))
        _IN_PIECES[session] = writers + 1, previous
        spark.conf.set(key, str(min(jvm_limit, int(previous or jvm_limit))))
    try:
        yield
    finally:
        with _LOCK:
            writers, previous = _IN_PIECES.pop(session)
            if writers > 1:
                _IN_PIECES[session] = writers - 1, previous
            elif previous is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, previous)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder the cluster names in spark.checkpoint.dir.

    Only a local-mode session that names none gets a folder on this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that every executor can reach.")
        if context.applicationId not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="gridloom-")
        root = _LOCAL_ROOTS[context.applicationId]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) for a location, resolved by its scheme."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def path_exists(spark: SparkSession, path: str) -> bool:
    filesystem, location = hadoop_path(spark, path)
    return filesystem.exists(location)


def list_paths(spark: SparkSession, folder: str) -> list[str]:
    """Direct children of a folder, sorted, without hidden and marker files."""
    filesystem, location = hadoop_path(spark, folder)
    found = [status.getPath().toString() for status in filesystem.listStatus(location)]
    return sorted(p for p in found if not os.path.basename(p).startswith(("_", ".")))


def folder_bytes(spark: SparkSession, folder: str) -> int:
    filesystem, location = hadoop_path(spark, folder)
    return filesystem.getContentSummary(location).getLength()


def publish(spark: SparkSession, built: str, target: str) -> None:
    """Put a finished folder in place of ``target``; an older one is kept until the new one is there."""
    filesystem, source = hadoop_path(spark, built)
    _, destination = hadoop_path(spark, target)
    _, previous = hadoop_path(spark, f"{target.rstrip('/')}__previous_{uuid.uuid4().hex}")
    if not filesystem.exists(source):
        raise OSError(f"'{built}' does not exist.")
    replaced = filesystem.exists(destination)
    if replaced and not filesystem.rename(destination, previous):
        raise OSError(f"Could not set aside '{target}'.")
    moved = False
    try:
        moved = filesystem.rename(source, destination)
    finally:
        if not moved and replaced:
            filesystem.rename(previous, destination)
    if not moved:
        raise OSError(f"Could not publish '{target}'.")
    if replaced:
        filesystem.delete(previous, True)


def resolve_column(df: DataFrame, name: str) -> str:
    """The column's own spelling; names compare without case."""
    for column in df.columns:
        if column.lower() == name.lower():
            return column
    raise ValueError(f"Column '{name}' does not exist.")


def quoted(name: str) -> str:
    """A column name as Spark SQL reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"
