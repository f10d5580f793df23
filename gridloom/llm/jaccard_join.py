"""N-gram Jaccard join: groups of documents whose sets of word shingles overlap, by T-occurrence search.

Equal sets are one class. Two classes link when their intersection is at least ``threshold`` of their
union; a set of n shingles then lacks at most a = floor((1 - threshold) n) of those it shares with a
partner. That gives exact bounds at every step; none is a guess, and nothing is capped.

1. A class is sketched by its 2a + 1 smallest shingle hashes. Linked classes share at least a + 1 of them
   (that of the smaller partner possible). Shingles that no other sketch has cannot be shared, so classes
   with too few others can have no partner and leave. Hashes are counted by shuffle, partial sums first.
2. Of the others, whole sets meet in blocks: by the smallest of their shared hashes in two orders, which
   partners of 0.9 have in common nine times in ten. Blocks are cut to a bounded size; two orders and cuts
   make pieces of a large group overlap. Within a block a T-occurrence search finds partners (below).
3. What may be missing are links between the groups found so far. The rarest hashes of a sketch, all but
   as many as must be shared less one, are a prefix that partners have a hash of in common (the long lists
   that DivideSkip leaves out are those of the other hashes). Lists of holders that lie in one group
   are done; of the others, pairs across groups are checked by size and by parity bits, whose difference
   is never larger than that of the sets, and those that pass by their sets. Lists are cut, too: classes
   of one large group meet those of others, never each other.

The search in a block takes sets by size. A DivideSkip merge counts, for each set, how often pivots occur
in the inverted lists of its shingles: the longest lists are set aside, the short ones merged by a heap,
and what may reach the bound is looked up in the long ones by bisection. A set that links to a pivot joins
its ball. Jaccard distance is a metric, so what is within twice the radius of a pivot may link to members
of its ball, and nothing else may; those members are compared unless they are in the same group already.

Shingles are 64-bit hashes, classes 128-bit digests of all of a set's hashes. Two different shingles of
one pair of documents are taken for one with a probability of about n^2 / 2^64.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import saved, whole_text
from gridloom.llm.simhash import components

SHINGLE_WORDS = 3
THRESHOLD = Fraction(9, 10)
BLOCK_SETS, BLOCK_SHINGLES = 128, 1 << 17
"""Sets of a block, and shingles in all of them together, about."""
LIST_ROWS = 256
"""Holders of a hash that are compared at a time."""
PARITY_BITS = 2048
"""Bits of a set's parities, at most; as many as it has shingles, about."""
BROADCAST_CLASSES = 200_000
"""Up to so many classes are sent to all tasks to find their texts; more are joined by shuffle."""
_LONG_LIST_COST = 0.01


# -- sets --------------------------------------------------------------------------------------------

def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return a ^ (a >> np.uint64(29))


def shingle_set(text: str, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; of all its words if they are fewer; none without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(width, len(words))
    found = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        found = _mixed(found * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + len(found)])
    return np.unique(found)


def missing(size, threshold: Fraction):
    """Shingles of a set of that size that a linked set may lack; for numbers."""
    return size * (threshold.denominator - threshold.numerator) // threshold.denominator


def _missing(size: Column, threshold: Fraction) -> Column:
    return F.floor(size * (threshold.denominator - threshold.numerator) / threshold.denominator).cast("bigint")


def sketch_size(size: int, threshold: Fraction) -> int:
    return min(size, 2 * missing(size, threshold) + 1)


def _shared(size: Column, threshold: Fraction) -> Column:
    """Hashes of its sketch that a set of that size shares at least with a linked one."""
    least = size - _missing(size, threshold)
    lacking = _missing(least, threshold)
    return F.least(least, 2 * lacking + 1) - lacking


def digest(hashes: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def parities(hashes: np.ndarray) -> bytes:
    """For each remainder of the hashes, whether an odd number has it."""
    bits = min(PARITY_BITS, max(64, 1 << (len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _prints(docs: DataFrame, id_column: str, text_column: str, width: int, threshold: Fraction) -> DataFrame:
    """A row per document: doc_id, text_hash, digest of its set, its size, its sketch."""
    text = whole_text(text_column)
    wanted = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [shingle_set(t.as_py(), width) for t in part.column(2)]
            sketches = [s[:sketch_size(len(s), threshold)].view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, sketches)])
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array(map(digest, sets), pa.binary()),
                pa.array(map(len, sets), pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sketches))),
            ], names=["doc_id", "text_hash", "digest", "n", "sketch"])

    return wanted.mapInArrow(batches, "doc_id bigint, text_hash bigint, digest binary, n bigint, sketch array<bigint>")


def _sets(docs: DataFrame, classes: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """cid, n, parity and hashes of classes (cid, digest, first), made anew from the text of one document each."""
    text = whole_text(text_column)
    wanted = classes.select("cid", "digest", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    if wanted.count() <= BROADCAST_CLASSES:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col(id_column).cast("bigint").alias("own_id"), F.xxhash64(text).alias("own_hash"), text.alias("text"))
    rows = rows.join(wanted, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [shingle_set(t.as_py(), width) for t in part.column(2)]
            right = np.array([digest(s) == d.as_py() for s, d in zip(sets, part.column(1))], dtype=bool)
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(map(len, sets), pa.int64()), pa.array(map(parities, sets), pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["cid", "n", "parity", "hashes"]).filter(pa.array(right))

    found = rows.select("cid", "digest", "text").mapInArrow(batches, "cid bigint, n bigint, parity binary, hashes binary")
    # one row for each class, though rows of one id and text may repeat
    return found.groupBy("cid").agg(F.first("n").alias("n"), F.first("parity").alias("parity"), F.first("hashes").alias("hashes"))


# -- the search within a block -----------------------------------------------------------------------

def t_occurrences(lists: list[list[int]], needed: int) -> dict[int, int]:
    """The numbers that are in at least ``needed`` of some sorted lists, and in how many (DivideSkip)."""
    if len(lists) < needed:
        return {}
    lists = sorted(lists, key=len, reverse=True)
    aside = min(needed - 1, int(needed / (_LONG_LIST_COST * math.log2(len(lists[0])) + 1)))
    found = {}
    for number, run in groupby(heapq.merge(*lists[aside:])):
        count = sum(1 for _ in run)
        for left, one in zip(range(aside, 0, -1), lists):
            if count + left < needed:
                break
            place = bisect_left(one, number)
            count += place < len(one) and one[place] == number
        if count >= needed:
            found[number] = count
    return found


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _links(overlap: int, a: int, b: int, threshold: Fraction) -> bool:
    return overlap * threshold.denominator >= (a + b - overlap) * threshold.numerator


def block_links(sets: list[np.ndarray], threshold: Fraction = THRESHOLD) -> list[tuple[int, int]]:
    """Links between places of ``sets`` that connect what is linked in the block; none is wrong."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    root = list(range(len(sets)))

    def group(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    wide = 2 * threshold - 1  # similarity to the pivot of a ball that may hold a linked set
    pivots: list[int] = []
    balls: list[list[int]] = []
    index: dict[int, list[int]] = {}
    links = []

    def link(a: int, b: int) -> None:
        if group(a) != group(b):
            root[group(a)] = group(b)
            links.append((a, b))

    for i in order:
        own = sets[i].tolist()
        if not own:
            continue
        lists = [index[h] for h in own if h in index]
        near = t_occurrences(lists, -(-len(own) * wide.numerator // wide.denominator))
        home, edge = None, []
        for pivot, overlap in near.items():
            size = len(sets[pivots[pivot]])
            if _links(overlap, len(own), size, threshold):
                link(i, pivots[pivot])
                home = pivot if home is None else home
            elif _links(overlap, len(own), size, wide):
                edge.append(pivot)
        for pivot in edge:
            for member in balls[pivot]:
                if group(member) == group(i):
                    break
                if _links(_overlap(sets[i], sets[member]), len(own), len(sets[member]), threshold):
                    link(i, member)
                    break
        if home is not None:
            balls[home].append(i)
            continue
        for h in own:
            index.setdefault(h, []).append(len(pivots))
        pivots.append(i)
        balls.append([])
    return links


def _runs(parts: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that are sorted by their first ``keys`` columns, a table for each key."""
    waiting: list[pa.Table] = []
    last = None
    for part in parts:
        if not part.num_rows:
            continue
        table = pa.Table.from_batches([part])
        columns = [table.column(i).to_pylist() for i in range(keys)]
        at = 0
        for key, run in groupby(zip(*columns)):
            size = sum(1 for _ in run)
            if key != last and waiting:
                yield pa.concat_tables(waiting)
                waiting = []
            waiting.append(table.slice(at, size))
            last, at = key, at + size
    if waiting:
        yield pa.concat_tables(waiting)


def _by_key(rows: DataFrame, keys: list[str], columns: list[str], found: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """Pairs (a, b) that ``found`` sees in the rows of each key; keys stay whole, and are many to a task."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int, int]] = []
        for table in _runs(parts, len(keys)):
            pairs += found(table)
            if len(pairs) > 1 << 16:
                yield _pairs(pairs)
                pairs = []
        yield _pairs(pairs)

    dealt = rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(batches, "a bigint, b bigint")


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _in_blocks(holders: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Links found where whole sets meet: blocks by the smallest of the shared hashes, in two orders."""
    orders = F.array(
        F.struct(F.lit(0).alias("turn"), F.array_min("shared").alias("hash")),
        F.struct(F.lit(1).alias("turn"), F.array_min(F.transform("shared", lambda h: F.xxhash64(h))).alias("hash")))
    chosen = saved(holders.select("cid", "n", F.explode(orders).alias("block")).select("cid", "n", "block.*"), "chosen")
    pieces = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    blocks = saved(chosen.groupBy("turn", "hash").agg(F.count("*").alias("holders"), pieces.alias("pieces"))
                   .where("holders > 1").drop("holders"), "blocks")
    placed = chosen.join(blocks, ["turn", "hash"]).select(
        "cid", "turn", "hash", F.pmod(F.xxhash64("cid", "hash"), F.col("pieces")).alias("piece"))

    def found(rows: pa.Table) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        ids = rows.column("cid").to_pylist()
        links = block_links([np.frombuffer(b.as_py(), dtype=np.uint64) for b in rows.column("hashes")], threshold)
        return [(ids[a], ids[b]) for a, b in links]

    return _by_key(saved(placed, "placed").join(sets.select("cid", "hashes"), "cid"),
                   ["turn", "hash", "piece"], ["cid", "hashes"], found)


# -- links across groups -----------------------------------------------------------------------------

def _close(rows: pa.Table, threshold: Fraction) -> list[tuple[int, int]]:
    """Pairs of rows (side, cid, root, n, parity) of different groups that sizes and parities allow.

    Side 0 is compared with side 1, and with itself where there is no side 1.
    """
    n = rows.column("n").to_numpy()
    order = np.argsort(n, kind="stable")
    n, ids, roots = n[order], rows.column("cid").to_numpy()[order], rows.column("root").to_numpy()[order]
    side = rows.column("side").to_numpy()[order]
    both = bool((side == 1).any())
    if (roots == roots[0]).all():
        return []
    held = rows.column("parity").to_pylist()
    words = [np.frombuffer(held[i], dtype=np.uint64) for i in order.tolist()]
    widths = np.array([len(w) for w in words])
    apart, whole = threshold.denominator - threshold.numerator, threshold.denominator + threshold.numerator
    ends = np.searchsorted(n, n * threshold.denominator // threshold.numerator, side="right")
    by_width = {int(w): (np.flatnonzero(widths == w), np.stack([x for x in words if len(x) == w])) for w in np.unique(widths)}
    found: list[tuple[int, int]] = []
    for i in range(len(n) - 1):
        others = np.arange(i + 1, ends[i])
        others = others[(roots[others] != roots[i]) & ((side[others] != side[i]) if both else True)]
        if not len(others):
            continue
        for width, (places, bits) in by_width.items():
            mine = others[widths[others] == width]
            if not len(mine):
                continue
            theirs = bits[np.searchsorted(places, mine)]
            # rows come by size, so those of others are as wide or wider: halves fold onto each other
            while theirs.shape[1] > len(words[i]):
                half = theirs.shape[1] // 2
                theirs = theirs[:, :half] ^ theirs[:, half:]
            differing = np.bitwise_count(theirs ^ words[i]).sum(axis=1, dtype=np.int64)
            found += [(int(ids[i]), int(ids[j])) for j in mine[differing * whole <= (n[mine] + n[i]) * apart]]
    return found


def _across(holders: DataFrame, sets: DataFrame, roots: DataFrame, threshold: Fraction) -> DataFrame:
    """Links between classes of different groups (node, root)."""
    prefix = F.slice("shared", 1, F.size("shared") - F.col("needed").cast("int") + 1)
    grouped = holders.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select(
        "cid", F.coalesce("root", "cid").alias("root"), F.explode(prefix).alias("hash"))
    grouped = saved(grouped, "prefixes")
    share = grouped.groupBy("hash", "root").agg(F.count("*").alias("own"))
    lists = saved(share.groupBy("hash").agg(
        F.count("*").alias("groups"), F.sum("own").alias("rows"),
        F.sum(F.when(F.col("own") <= LIST_ROWS, F.col("own")).otherwise(0)).alias("mixed")).where("groups > 1").drop("groups"), "lists")
    open_rows = saved(grouped.join(lists, "hash"), "open-lists")
    whole = open_rows.where(F.col("rows") <= LIST_ROWS).select(
        "hash", F.lit("").alias("left"), F.lit("").alias("right"), F.lit(0).alias("side"), "cid", "root")
    # a long list is cut: pieces of mixed groups, and pieces of one large group each
    long_rows = open_rows.where(F.col("rows") > LIST_ROWS)
    share = long_rows.groupBy("hash", "root").agg(F.count("*").alias("own"))
    cut = long_rows.join(saved(share, "large-groups"), ["hash", "root"]).select(
        "hash", "cid", "root", F.when(F.col("own") > LIST_ROWS, F.col("root")).otherwise(F.lit(-1)).alias("large"),
        F.pmod(F.xxhash64("cid"), F.ceil(F.when(F.col("own") > LIST_ROWS, F.col("own")).otherwise(F.col("mixed")) / LIST_ROWS)).alias("piece"))
    cut = saved(cut.withColumn("name", F.concat_ws(":", "large", "piece")), "pieces")
    names = saved(cut.select("hash", "large", "name").distinct(), "piece-names")
    meet = names.alias("a").join(names.alias("b"), "hash").where(
        "a.name <= b.name AND NOT (a.large = b.large AND a.large >= 0)").select(
        "hash", F.col("a.name").alias("left"), F.col("b.name").alias("right"))
    meet = saved(meet, "meetings")
    ends = meet.select("*", F.col("left").alias("name"), F.lit(0).alias("side")).unionByName(
        meet.where(F.col("left") != F.col("right")).select("*", F.col("right").alias("name"), F.lit(1).alias("side")))
    parted = cut.join(ends, ["hash", "name"]).select("hash", "left", "right", "side", "cid", "root")
    rows = saved(whole.unionByName(parted), "across").join(sets.select("cid", "n", "parity"), "cid")
    close = _by_key(rows, ["hash", "left", "right"], ["side", "cid", "root", "n", "parity"], lambda t: _close(t, threshold))
    close = saved(close.distinct(), "close-pairs")
    hashes = sets.select("cid", "hashes")
    pairs = close.join(hashes.toDF("a", "left"), "a").join(hashes.toDF("b", "right"), "b").select("a", "b", "left", "right")

    def linked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            good = []
            for left, right in zip(part.column(2), part.column(3)):
                x, y = (np.frombuffer(h.as_py(), dtype=np.uint64) for h in (left, right))
                good.append(_links(_overlap(x, y), len(x), len(y), threshold))
            yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(linked, "a bigint, b bigint")


def _classes(docs: DataFrame, id_column: str, text_column: str, width: int, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """Every row with its digest, and every class: cid, digest, n, first (a row that has it), sketch."""
    prints = saved(_prints(docs, id_column, text_column, width, threshold), "shingle-prints")
    first = F.struct(F.isnull("doc_id").alias("unknown"), "doc_id", "text_hash")
    classes = prints.where("n > 0").groupBy("digest").agg(
        F.min(first).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    return prints.select("doc_id", "digest", "n"), saved(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")


def class_links(docs: DataFrame, classes: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                shingle_words: int = SHINGLE_WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """Links (a, b) between classes (cid) that connect every group, none wrong."""
    hashes = saved(classes.select("cid", "n", F.explode("sketch").alias("hash")), "sketches")
    held = saved(hashes.groupBy("hash").agg(F.count("*").alias("holders")).where("holders > 1"), "holders")
    in_common = hashes.join(held, "hash").groupBy("cid", "n").agg(
        F.sort_array(F.collect_list(F.struct("holders", "hash"))).alias("found"))
    needed = _shared(F.col("n"), threshold)
    holders = saved(in_common.select("cid", "n", needed.alias("needed"), F.col("found.hash").alias("shared")).where(
        F.size("shared") >= F.col("needed")), "shared-sketches")
    wanted = classes.join(holders.select("cid"), "cid").select("cid", "digest", "first")
    sets = saved(_sets(docs, saved(wanted, "wanted"), id_column, text_column, shingle_words), "sets")
    near = saved(_in_blocks(holders, sets, threshold), "block-links")
    return near.unionByName(saved(_across(holders, sets, components(near), threshold), "links-across"))


def jaccard_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   shingle_words: int = SHINGLE_WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included).

    A null or empty text, or one without words, has no shingles and links with nothing, not even its like;
    a text of fewer words than a shingle is one shingle. Rows that repeat a doc_id each count with their own
    text. A null doc_id takes part in links and is never the smallest, unless its group has no other. Other
    columns are ignored. No rows give no rows. ``threshold`` lies above 1/2.
    """
    if not Fraction(1, 2) < threshold <= 1:
        raise ValueError("The threshold must lie above 1/2 and be at most 1.")
    prints, classes = _classes(docs, id_column, text_column, shingle_words, threshold)
    roots = components(class_links(docs, classes, id_column, text_column, shingle_words, threshold))
    placed = saved(classes.join(roots, classes["cid"] == roots["node"], "left").select(
        "digest", "first", F.coalesce("root", "cid").alias("root")), "placed")
    smallest = saved(placed.groupBy("root").agg(F.min("first").alias("stays")), "smallest")
    groups = saved(placed.drop("first").join(smallest, "root").select("digest", F.col("stays.doc_id").alias("component_id")), "groups")
    return prints.join(groups, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
