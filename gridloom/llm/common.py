"""What the operators share: materialized steps, whole texts, choosing rows by document and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.cluster import scratch_dir


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written as Parquet below spark.checkpoint.dir and read again.

    Cuts the lineage, fixes generated ids, and survives a lost executor.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or the first of ``wanted_1``, ``wanted_2`` ... that the rows do not have."""
    taken = {c.lower() for c in df.columns}
    name, n = wanted, 0
    while name.lower() in taken:
        n += 1
        name = f"{wanted}_{n}"
    return name


def first_by_hash(rows: DataFrame, key: str, most: int, total: int | None = None) -> list[Row]:
    """The ``most`` rows that are first by the 64-bit hash in column ``key``, then by the other columns.

    A sort with a limit sends that many rows from every task. Here rows are filtered first, by a bound
    of the hash under which about twice as many lie in all; it is raised if that was too low. ``total``
    saves a count of the rows, and may be too large.
    """
    total = rows.count() if total is None else total
    share = 2 * most / max(total, 1)
    while True:
        low = rows if share >= 1 else rows.where(F.col(key) < F.lit(int((share - 0.5) * 2.0 ** 64)))
        found = low.orderBy(key, *(c for c in rows.columns if c != key)).limit(most).collect()
        if len(found) == most or share >= 1:
            return found
        share *= 4


def keep_rows(docs: DataFrame, keepers: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of ``docs`` for each (id, SHA-256 of the text) in ``keepers``, with the columns of ``docs``.

    ``keepers`` has ``keep_doc`` and ``keep_sha``, each pair once. Rows that repeat both id and text
    are rare; only they are ranked (by their other columns), all others pass a semi join.
    """
    sha, rank = free_name(docs, "_sha"), free_name(docs, "_rank")
    key, digest = free_name(docs, "_keep_doc"), free_name(docs, "_keep_sha")
    tagged = docs.withColumn(sha, F.sha2(F.encode(whole_text(text_column), "utf-8"), 256))
    keepers = keepers.select(F.col("keep_doc").alias(key), F.col("keep_sha").alias(digest))
    same = F.col(id_column).eqNullSafe(F.col(key)) & (F.col(sha) == F.col(digest))
    kept = tagged.join(keepers, same, "left_semi")
    # only ids and digests are read here
    repeated = saved(
        tagged.groupBy(F.col(id_column).alias(key), F.col(sha).alias(digest)).agg(F.count("*").alias("_n"))
        .where("_n > 1").drop("_n"), "repeated")
    if repeated.isEmpty():
        return kept.drop(sha)
    others = [F.to_json(F.struct(F.col(c).alias("v"))) for c in docs.columns if c not in (id_column, text_column)]
    first = Window.partitionBy(id_column, sha).orderBy(*(others or [F.lit(0)]))
    ranked = kept.join(repeated, same, "left_semi").withColumn(rank, F.row_number().over(first))
    return kept.join(repeated, same, "left_anti").unionByName(ranked.where(F.col(rank) == 1).drop(rank)).drop(sha)
