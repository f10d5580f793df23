"""SQL over a folder of tables: a database whose tables are Parquet folders there."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession

from gridloom.cluster import hadoop_path, list_paths, path_exists, quoted, scratch_dir
from gridloom.functions.sqlite import register_functions
from gridloom.plans.sqltext import analyzed, statements, tokens


def prepare_session(spark: SparkSession) -> None:
    """Register the SQL functions and let recursive queries run to their end."""
    register_functions(spark)
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")


class Workspace:
    """Tables below one folder, ready for SQL; tables that SQL makes are there, too."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        prepare_session(spark)
        filesystem, location = hadoop_path(spark, self.folder)
        place = filesystem.makeQualified(location).toString()
        self.database = f"workspace_{md5(place.encode()).hexdigest()[:16]}"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database} LOCATION '{_escaped(place)}'")
        known = {t.name.lower() for t in spark.catalog.listTables(self.database) if not t.isTemporary}
        if path_exists(spark, self.folder):
            for path in list_paths(spark, self.folder):
                name = path.rsplit("/", 1)[-1]
                if name.lower() not in known:
                    spark.sql(f"CREATE TABLE {self._name(name)} USING parquet LOCATION '{_escaped(path)}'")

    def _name(self, name: str) -> str:
        return f"{self.database}.{quoted(name)}"

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table; an existing one of that name is an error."""
        df.write.format("parquet").mode("error").saveAsTable(self._name(name))
        return self.spark.table(self._name(name))

    def sql(self, statement: str) -> DataFrame:
        """One statement; the result is lazy and complete."""
        return self._within(lambda: analyzed(self.spark, statement))

    def script(self, text: str | Sequence[str]) -> DataFrame:
        return self._within(lambda: run_script(self.spark, text))

    def _within(self, run):
        """Names without a database are those of the workspace, while a statement is analyzed."""
        before = self.spark.catalog.currentDatabase()
        self.spark.catalog.setCurrentDatabase(self.database)
        try:
            return run()
        finally:
            self.spark.catalog.setCurrentDatabase(before)


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _reads_only(statement: str) -> bool:
    first = next((t.upper() for kind, t in tokens(statement) if kind not in ("space", "comment")), "")
    return first in ("SELECT", "WITH", "VALUES", "(", "SHOW", "DESCRIBE", "EXPLAIN") and not any(
        kind == "word" and t.upper() == "INSERT" for kind, t in tokens(statement))


def run_script(spark: SparkSession, script: str | Sequence[str]) -> DataFrame:
    """Run statements in order; the last one that returns columns gives the result.

    A result is as its statement found the tables: before a later statement that may change them, it is
    written down.
    """
    parts = statements(script) if isinstance(script, str) else list(script)
    result, fixed = None, True
    for statement in parts:
        if result is not None and not fixed and not _reads_only(statement):
            folder = scratch_dir(spark, "result")
            result.write.parquet(folder)
            result, fixed = spark.read.schema(result.schema).parquet(folder), True
        answer = analyzed(spark, statement)
        if answer.columns:
            result, fixed = answer, False
    if result is None:
        return spark.createDataFrame([], "status string")
    return result
