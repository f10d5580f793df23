"""How the sources of a language differ: distances between their word distributions, and each one's own words.

Terms are counted in the tasks and summed by shuffle. Terms that enough documents of a language have are
its vocabulary; every source of the language (a group) has a smoothed share for each of its terms.

Words of a source are ranked by how much their share in the group exceeds that in the language. The share
in the group rises with the count there, that in the language with the count there; so a term comes before
every other one that has no higher count in the group, no lower count in the language and is later in
UTF-8. A term that k others dominate so is not among the first k. Every partition therefore keeps, for
each group, only the terms that fewer than k others dominate: its skyband. Skybands of partitions are
merged into that of the group, in steps, and what remains is ranked exactly.

Distances need all terms. The vocabulary is cut in blocks; a task sums a block's differences for each
pair of sources, and the sums of blocks are added up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import saved, whole_text

MIN_DOCS = 30
"""Documents of a language that must have a term."""
PRIOR = 5
SCALE = 1_000_000_000
FIRST = 50
"""Terms that are listed for each group."""
HELD = 300_000
"""Terms that a task counts before it passes them on."""
CUT_AT = 8192
"""Rows of a group that a task gathers before it cuts them to their skyband."""
BLOCK_CELLS = 1 << 17
"""Terms times sources of a block of the vocabulary."""

# bytes of a term stay, A-Z in lower case; all other ASCII parts terms
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII, in UTF-8, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text_column: str = "text", held: int = HELD) -> DataFrame:
    """lang, source, term, count (occurrences) and docs (documents that have it), once for each group and term."""
    wanted = docs.select(*_group(lang, source), whole_text(text_column).alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (a, b), (times, having) in counts.items():
                terms = list(times)
                size = len(terms)
                yield pa.RecordBatch.from_arrays([
                    pa.array([a]).take(pa.array(np.zeros(size, dtype=np.int64))),
                    pa.array([b]).take(pa.array(np.zeros(size, dtype=np.int64))),
                    pa.array(terms, pa.binary()).cast(pa.string()), pa.array(map(times.get, terms), pa.int64()),
                    pa.array(map(having.get, terms), pa.int64())], names=["lang", "source", "term", "count", "docs"])
            counts.clear()

        for part in parts:
            for a, b, text in zip(*(c.to_pylist() for c in part.columns)):
                terms = terms_of(text)
                if not terms:
                    continue
                times, having = counts.setdefault((a, b), (Counter(), Counter()))
                times.update(terms)
                having.update(set(terms))
            if sum(len(times) for times, _ in counts.values()) > held:
                yield from passed_on()
        yield from passed_on()

    found = wanted.mapInArrow(batches, "lang string, source string, term string, count bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _group(lang: str, source: str) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]


def _share(count: str, total: str, prior: int, scale: int) -> Column:
    """1 + floor(scale (count + prior) / (total + prior V)), exact beyond 64 bits."""
    return F.expr(f"1 + (CAST({scale} AS DECIMAL(19,0)) * CAST({count} + {prior} AS DECIMAL(19,0))) div "
                  f"CAST({total} + {prior} * vocabulary AS DECIMAL(38,0))").cast("bigint")


# -- the skyband -------------------------------------------------------------------------------------

def skyband(here: np.ndarray, overall: np.ndarray, terms: list[str], k: int) -> list[int]:
    """Places of the terms that fewer than ``k`` others dominate, by term.

    Another term dominates if its count here is no lower, its count overall no higher, and it is earlier
    in UTF-8. Terms are taken in that order, so dominators come first. A term with k dominators has k
    within the band, too: of its dominators, the first k in any order that respects dominance are in it.
    """
    order = sorted(range(len(terms)), key=terms.__getitem__)  # by code points, which is the order of UTF-8
    band_here, band_overall = np.empty(len(terms), dtype=np.int64), np.empty(len(terms), dtype=np.int64)
    kept: list[int] = []
    for i in order:
        size = len(kept)
        if size >= k and np.count_nonzero((band_here[:size] >= here[i]) & (band_overall[:size] <= overall[i])) >= k:
            continue
        band_here[size], band_overall[size] = here[i], overall[i]
        kept.append(i)
    return kept


_BAND = "lang string, source string, term string, count bigint, lang_count bigint"


def _banded(k: int):
    """Rows of one group, cut to their skyband."""
    def cut(rows: pa.Table) -> pa.Table:
        kept = skyband(rows.column("count").to_numpy(), rows.column("lang_count").to_numpy(), rows.column("term").to_pylist(), k)
        return rows.take(pa.array(kept, pa.int64()))
    return cut


def _partition_bands(k: int, held: int):
    """The skybands of a partition's groups; a group's rows wait for each other, and are cut when they have doubled."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _banded(k)
        waiting: dict[tuple, list[pa.Table]] = {}
        cut_at: dict[tuple, int] = {}
        rows_held = 0
        for part in parts:
            table = pa.Table.from_batches([part])
            places: dict[tuple, list[int]] = {}
            for place, group in enumerate(zip(table.column("lang").to_pylist(), table.column("source").to_pylist())):
                places.setdefault(group, []).append(place)
            for group, found in places.items():
                waiting.setdefault(group, []).append(table.take(pa.array(found, pa.int64())))
                rows_held += len(found)
                rows = sum(map(len, waiting[group]))
                if rows > cut_at.get(group, CUT_AT):
                    band = cut(pa.concat_tables(waiting[group]))
                    waiting[group], cut_at[group] = [band], max(CUT_AT, 2 * len(band))
                    rows_held += len(band) - rows
            if rows_held > held:
                for tables in waiting.values():
                    yield from cut(pa.concat_tables(tables)).combine_chunks().to_batches()
                waiting.clear()
                cut_at.clear()
                rows_held = 0
        for tables in waiting.values():
            yield from cut(pa.concat_tables(tables)).combine_chunks().to_batches()
    return batches


def own_terms(counts: DataFrame, first: int, held: int = HELD) -> DataFrame:
    """Of rows lang, source, term, count, lang_count: those that fewer than ``first`` others of their group dominate."""
    bands = counts.select("lang", "source", "term", "count", "lang_count").mapInArrow(_partition_bands(first, held), _BAND)
    bands = saved(bands.withColumn("task", F.spark_partition_id()), "partition-bands")
    tasks = (bands.agg(F.max("task")).first()[0] or 0) + 1
    # a group's bands meet in a root of the number of tasks, then in one
    half = bands.withColumn("task", F.pmod("task", F.lit(max(1, round(tasks ** 0.5)))))
    merged = half.groupBy("lang", "source", "task").applyInArrow(lambda rows: _banded(first)(rows.drop(["task"])), _BAND)
    return merged.groupBy("lang", "source").applyInArrow(_banded(first), _BAND)


# -- distances ---------------------------------------------------------------------------------------

def _distances(key: tuple, rows: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of differences over a block of the vocabulary, for each pair of sources of a language."""
    sources = sorted(zip(groups.column("source").to_pylist(), groups.column("rest").to_pylist()))
    place = {source: i for i, (source, _) in enumerate(sources)}
    terms: dict[str, int] = {}
    column = [terms.setdefault(t, len(terms)) for t in rows.column("term").to_pylist()]
    shares = np.repeat(np.array([[rest] for _, rest in sources], dtype=np.int64).reshape(-1, 1), len(terms), axis=1)
    shares[[place[s] for s in rows.column("source").to_pylist()], column] = rows.column("share").to_numpy()
    a, b, value = [], [], []
    for i in range(len(sources) - 1):
        value.append(np.abs(shares[i + 1:] - shares[i]).sum(axis=1))
        a.append(np.full(len(value[-1]), i))
        b.append(np.arange(i + 1, len(sources)))
    names = pa.array([s for s, _ in sources], pa.string())
    empty = np.zeros(0, dtype=np.int64)
    a, b, value = (np.concatenate([empty, *x]) for x in (a, b, value))
    return pa.table({
        "lang": pa.array([key[0].as_py()] * len(a), pa.string()), "source": names.take(pa.array(a)),
        "item": names.take(pa.array(b)), "value": pa.array(value, pa.int64())})


def source_distances(shares: DataFrame, groups: DataFrame, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """lang, source, item (another source of the language), value: the sum of their shares' differences.

    ``shares``: lang, source, term, share where the group has the term. ``groups``: lang, source, rest (the
    share of a term that the group does not have), vocabulary (terms of the language).
    """
    sized = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(
        F.count("*") * F.max("vocabulary") / F.lit(block_cells))).cast("int").alias("blocks"))
    sized = saved(sized, "blocks")
    rows = shares.join(sized, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "share")
    everywhere = groups.join(sized, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "rest")
    found = rows.groupBy("lang", "block").cogroup(everywhere.groupBy("lang", "block")).applyInArrow(
        _distances, "lang string, source string, item string, value bigint")
    # every source with every other one, both ways; languages of one source have no pairs
    found = saved(found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "distances")
    return found.unionByName(found.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text_column: str = "text",
                      min_docs: int = MIN_DOCS, prior: int = PRIOR, scale: int = SCALE, first: int = FIRST) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs from the others and from all.

    Part ``pair``: item is another source of the language, value the sum over the vocabulary of the
    differences of their shares; all ranks. Part ``term``: item is a term whose share in the group exceeds that
    in the language, value by how much; the ``first`` ones. Ranks by value, highest first, then by the
    item's UTF-8. A null lang, source or text counts as empty. A group without terms has its pairs and no terms; of
    a language without vocabulary all distances are 0. Rows that repeat each count; other columns are
    ignored; no rows give no rows.
    """
    counts = saved(term_counts(docs, lang, source, text_column), "term-counts")
    vocabulary = saved(counts.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("docs").alias("docs"))
                       .where(F.col("docs") >= min_docs).drop("docs"), "vocabulary")
    kept = saved(counts.join(vocabulary, ["lang", "term"]).drop("docs"), "kept-counts")
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("lang_count").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = docs.select(*_group(lang, source)).distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.fillna(0, ["total", "vocabulary", "lang_total"])
    # no share is asked for where there is no vocabulary
    rest = F.when(F.col("vocabulary") > 0, _share("0", "total", prior, scale)).otherwise(F.lit(0)).alias("rest")
    groups = saved(groups.select("lang", "source", "total", "vocabulary", "lang_total", rest), "groups")
    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", _share("count", "total", prior, scale).alias("share"))
    pairs = source_distances(shares, groups)
    terms = own_terms(kept, first).join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"),
        (_share("count", "total", prior, scale) - _share("lang_count", "lang_total", prior, scale)).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.where("value > 0").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= first)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair")).select(columns).unionByName(
        terms.withColumn("part", F.lit("term")).select(columns))
