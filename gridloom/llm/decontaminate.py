"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document if at least ``min_share`` of its distinct five-word shingles occur there,
wherever the document has them and however long it is. Similarity of whole sets says nothing here: an
item of 30 shingles in a document of 20,000 words has a Jaccard similarity of 0.0015, which bands of a
fixed number of minima (256) find one time in three. So the sketches are sized by the item. With n shingles,
of which k must occur, any n - k + 1 of them include one that does. An item's sketch is its n - k + 1
smallest hashes, a document's sketch all of its hashes up to the largest that a sketch has. To keep that
bound tight, items are partitioned by size, with a bound for each partition. A document is a
candidate for an item if their sketches share a hash; no item can be missed. Candidates are verified by
counting the item's shingles in the document, as words and not as hashes.

Items are sent to the tasks in blocks of a fixed number of characters, so that what is broadcast does
not grow with the benchmark; a benchmark of one block takes one pass over the documents without a
shuffle, others a pass for each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import free_name, saved, whole_text

SHINGLE_WORDS = 5
MIN_SHARE = Fraction(4, 5)
BLOCK_CHARS = 8_000_000
"""Characters of items that are broadcast at a time; the index of a block takes about ten bytes for each."""
_WORD = re.compile(r"[^\W_]+")
_FOUND = "array<struct<item_id: bigint, containment: double>>"


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return _WORD.findall(text.lower())


def _mixed(columns) -> np.ndarray:
    """A hash for each row of word numbers, given by columns."""
    mixed = np.zeros(len(columns[0]), dtype=np.uint64)
    for part in columns:
        mixed = (mixed ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _hashes(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words that are all known, and which runs those are; number 0 stands for other words."""
    count = len(ids) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    columns = [ids[i:i + count] for i in range(width)]
    known = np.logical_and.reduce([c > 0 for c in columns])
    return _mixed([c[known] for c in columns]), known


class _Runs:
    """The runs of ``width`` words of a text that an index knows, by hash."""

    def __init__(self, ids: np.ndarray, width: int):
        hashes, known = _hashes(ids, width)
        self.ids, self.width = ids, width
        self.places = np.flatnonzero(known)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places = hashes[order], self.places[order]
        self.distinct = np.unique(self.hashes)

    def count(self, hashes: np.ndarray, shingles: np.ndarray) -> int:
        """How many of the shingles (rows of word ids, with their hashes) occur, compared word by word."""
        left = np.searchsorted(self.hashes, hashes, "left")
        right = np.searchsorted(self.hashes, hashes, "right")
        there = np.flatnonzero(left < right)
        steps = np.arange(self.width)
        same = (self.ids[self.places[left[there]][:, None] + steps] == shingles[there]).all(axis=1)
        found = int(same.sum())
        for i in there[~same].tolist():
            # runs of other words that share the hash
            others = self.places[left[i] + 1:right[i]][:, None] + steps
            found += bool((self.ids[others] == shingles[i]).all(axis=1).any())
        return found


class ItemIndex:
    """Sketches of a block of items, by shingle width and size partition, and what verifies them.

    Shingles are rows of word numbers in arrays, four bytes a word, with a hash of eight bytes each.
    """

    def __init__(self, items: list[tuple[int, str]], shingle_words: int, min_share: Fraction):
        self.ids: dict[str, int] = {}
        self.items: dict[int, tuple[int, int, np.ndarray, np.ndarray]] = {}  # place: item id, shingles needed, hashes, shingles
        sketches: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
        for place, (item, text) in enumerate(items):
            words = words_of(text)
            if not words:
                continue
            width = min(shingle_words, len(words))
            ids = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], dtype=np.int32)
            shingles = np.unique(np.lib.stride_tricks.sliding_window_view(ids, width), axis=0)
            hashes = _mixed(shingles.T)
            needed = -(-len(shingles) * min_share.numerator // min_share.denominator)
            self.items[place] = (item, needed, hashes, shingles)
            smallest = np.unique(hashes)[:len(shingles) - needed + 1]
            sketches.setdefault((width, len(shingles).bit_length()), []).append((smallest, place))
        self.partitions = []
        for (width, _), members in sorted(sketches.items(), key=lambda x: x[0]):
            hashes = np.concatenate([h for h, _ in members])
            places = np.concatenate([np.full(len(h), place, dtype=np.int32) for h, place in members])
            order = np.argsort(hashes, kind="stable")
            self.partitions.append((width, hashes[order], places[order]))

    def found(self, text: str) -> list[tuple[int, float]]:
        """(item id, containment) of every item that the text holds."""
        words = words_of(text)
        ids = np.fromiter((self.ids.get(w, 0) for w in words), dtype=np.int32, count=len(words))
        candidates: set[int] = set()
        runs: dict[int, _Runs] = {}
        for width, hashes, places in self.partitions:
            if width not in runs:
                runs[width] = _Runs(ids, width)
            sketch = runs[width].distinct
            sketch = sketch[:np.searchsorted(sketch, hashes[-1], side="right")]
            left, right = np.searchsorted(hashes, sketch, "left"), np.searchsorted(hashes, sketch, "right")
            for a, b in zip(left[left < right].tolist(), right[left < right].tolist()):
                candidates.update(places[a:b].tolist())
        result = []
        for place in candidates:
            item, needed, hashes, shingles = self.items[place]
            hits = runs[shingles.shape[1]].count(hashes, shingles)
            if hits >= needed:
                result.append((item, hits / len(shingles)))
        return sorted(result)


def _finder(spark, items: list[tuple[int, str]], shingle_words: int, min_share: Fraction):
    """A function of texts that finds the items, and the broadcast that it needs."""
    index = spark.sparkContext.broadcast(ItemIndex(items, shingle_words, min_share))

    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([[{"item_id": i, "containment": c} for i, c in index.value.found(t)] for t in part], dtype=object)

    return F.pandas_udf(find, _FOUND), index


def _blocks(benchmark: DataFrame, block_chars: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """The distinct items, in blocks of about ``block_chars`` characters: how many, and each when it is asked for."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), whole_text().alias("text")).where(
        F.col("item_id").isNotNull()).distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))

    def collected(block: int) -> list[tuple[int, str]]:
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        return sorted((r["item_id"], r["text"]) for r in part.collect())

    return blocks, map(collected, range(blocks))


def with_items(docs: DataFrame, benchmark: DataFrame, into: str, id_column: str = "doc_id", text_column: str = "text",
               shingle_words: int = SHINGLE_WORDS, min_share: Fraction = MIN_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with a column ``into``: (item_id, containment) of the items found, by item_id.

    A null or empty text holds no item, and an item without words is in no document. An item of fewer
    words than a shingle is searched as one shingle of its own length. Items that repeat are one item;
    an item_id with several texts is found if any of them is, with its largest containment. Items
    without an id are left out. Rows that repeat are each searched. Other columns pass unchanged.
    """
    spark, text = docs.sparkSession, whole_text(text_column)
    count, blocks = _blocks(benchmark, block_chars)
    # one block at a time is collected, indexed and broadcast
    finders = (_finder(spark, items, shingle_words, min_share) for items in blocks)
    if count == 1:
        found = docs.withColumn(into, next(finders)[0](text))
    else:
        sha, key, digest = free_name(docs, "_sha"), free_name(docs, "_key"), free_name(docs, "_digest")
        tagged = docs.withColumn(sha, F.sha2(F.encode(text, "utf-8"), 256))
        parts = []
        for find, index in finders:
            hits = tagged.select(F.col(id_column).alias(key), F.col(sha).alias(digest), F.explode(find(text)).alias(into))
            parts.append(saved(hits, "items"))
            index.destroy()
            del find, index, hits
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        every = every.distinct().groupBy(key, digest).agg(F.array_sort(F.collect_list(into)).alias(into))
        same = F.col(id_column).eqNullSafe(F.col(key)) & (F.col(sha) == F.col(digest))
        found = tagged.join(every, same, "left").drop(sha, key, digest).withColumn(
            into, F.coalesce(into, F.array().cast(_FOUND)))
    # one entry for each item id
    ids = F.array_distinct(F.transform(into, lambda x: x["item_id"]))
    most = F.transform(ids, lambda i: F.struct(i.alias("item_id"), F.array_max(F.transform(F.filter(
        into, lambda x: x["item_id"] == i), lambda x: x["containment"])).alias("containment")))
    return found.withColumn(into, most)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document: doc_id, contaminated, n_items, item_ids (joined by commas), containment (the largest)."""
    found = with_items(docs.select("doc_id", "text"), benchmark, "found")
    return found.select(
        "doc_id", (F.size("found") > 0).alias("contaminated"), F.size("found").cast("bigint").alias("n_items"),
        F.array_join(F.transform("found", lambda x: x["item_id"].cast("string")), ",").alias("item_ids"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["containment"])), F.lit(0.0)).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark, with all their columns."""
    into = free_name(docs, "_found")
    return with_items(docs, benchmark, into).where(F.size(into) == 0).drop(into)
