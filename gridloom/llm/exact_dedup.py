"""Exact duplicates by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. All distinct blocks are sorted and get
integer names; then adjacent names are paired, the distinct pairs are sorted and named in turn, and
so on until a document has one name. Two documents end at the same (round, name) exactly if their
texts are equal: a name stands for one sequence of bytes, because names are given to distinct sorted
values, not computed from them.

Texts move once, as distinct blocks. Rows carry SHA-256 keys of their blocks to look the names up;
that each key stands for one block is checked on the named blocks, and if a key ever stood for two,
the blocks themselves become the keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import keep_rows, saved, whole_text

BLOCK_BYTES = 4096


def _sha_key(block: Column) -> Column:
    return F.unhex(F.sha2(block, 256))


def _block_key(block: Column) -> Column:
    return block


def _blocks(block_bytes: int, of: Callable[[Column], Column]) -> Column:
    """``of`` each block of ``raw``, in order. Binary slices cost their own length only."""
    last = F.greatest(F.ceil(F.length("raw") / F.lit(block_bytes)), F.lit(1)) - 1
    return F.transform(
        F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")),
        lambda i: of(F.substr(F.col("raw"), (i * block_bytes + 1).cast("int"), F.lit(block_bytes))))


def _named(distinct: DataFrame, *keys: str) -> DataFrame:
    """Integer names for distinct rows: their place in the sorted partitions. Fixed once written."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _identities(docs: DataFrame, id_column: str, text_column: str, block_bytes: int,
                keys: tuple[Callable[[Column], Column], ...]) -> DataFrame:
    """A row per document: row_id, doc_id, text_sha256, round, name."""
    raw = docs.select(
        F.col(id_column).alias("doc_id"), F.encode(whole_text(text_column), "utf-8").alias("raw"))
    for key in keys:
        names = raw.select(F.explode(_blocks(block_bytes, lambda b: b)).alias("block")).distinct()
        names = saved(_named(names, "block").select(key(F.col("block")).alias("key"), "name"), "block-names")
        if names.groupBy("key").count().where("count > 1").isEmpty():
            break
    # every row with its keys, once: the row ids must not change between the rounds
    rows = saved(raw.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id",
        F.sha2("raw", 256).alias("text_sha256"), _blocks(block_bytes, key).alias("keys")), "blocks")
    row = ["row_id", "doc_id", "text_sha256"]
    current = saved(_regrouped(
        rows.select(*row, F.posexplode("keys").alias("pos", "key")).join(names, "key"), row), "names")
    done, level = [], 0
    while True:
        done.append(current.where(F.size("names") == 1)
                    .select(*row, F.lit(level).alias("round"), F.col("names")[0].alias("name")))
        current = current.where(F.size("names") > 1)
        if current.isEmpty():
            break
        pairs = current.select(*row, F.posexplode(F.expr(
            "transform(sequence(0, (size(names) - 1) div 2), "
            "i -> struct(names[2 * i] AS a, coalesce(get(names, 2 * i + 1), -1L) AS b))")).alias("pos", "pair"))
        pairs = pairs.select(*row, "pos", "pair.a", "pair.b")
        names = saved(_named(pairs.select("a", "b").distinct(), "a", "b"), "pair-names")
        current = saved(_regrouped(pairs.join(names, ["a", "b"]), row), "names")
        level += 1
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return every


def _regrouped(named: DataFrame, row: list[str]) -> DataFrame:
    """The names of each document in text order."""
    order = F.array_sort(F.collect_list(F.struct("pos", "name")))
    return named.groupBy(*row).agg(F.transform(order, lambda x: x["name"]).alias("names"))


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 block_bytes: int = BLOCK_BYTES,
                 keys: tuple[Callable[[Column], Column], ...] = (_sha_key, _block_key)) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when all their bytes are. Of equal texts the row with the largest doc_id is kept;
    among rows that repeat that doc_id, one. Null texts count as empty, and empty texts are equal.
    A null doc_id is smaller than any other; a group of only such rows has a null keep_id and still
    keeps one row. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    rows = saved(_identities(docs, id_column, text_column, block_bytes, keys), "identities")
    # written down, so that both sides of the join are plain shuffles, whose large groups Spark can split
    groups = saved(rows.groupBy("round", "name").agg(
        F.max(F.struct("doc_id", (-F.col("row_id")).alias("first"))).alias("keep"), F.count("*").alias("group_size")), "groups")
    return rows.join(groups, ["round", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("row_id") == -F.col("keep.first")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The kept rows of ``docs``, with all their columns."""
    keepers = exact_groups(docs, id_column, text_column).where("kept").select(
        F.col("doc_id").alias("keep_doc"), F.col("text_sha256").alias("keep_sha"))
    return keep_rows(docs, saved(keepers, "keepers"), id_column, text_column)
