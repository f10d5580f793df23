"""Near-duplicates by SimHash fingerprints and vantage-point trees.

Fingerprints link at a Hamming distance of at most ``radius``. Hamming distance is a metric, so a tree
of vantage points cuts the space into shards by distance ranges. A fingerprint lives in one shard and
is sent as a query to every other shard whose ranges come within ``radius`` of its own distances: by
the triangle inequality no link can be missed. Each pair of shards is compared in one direction only.
In a shard a local tree prunes in the same way. What leaves a shard is a spanning forest of its links,
never all pairs, so that a large group of close fingerprints stays small. Groups are then found by
rounds of joins that pull every fingerprint towards the smallest of its component.

Only a bounded sample of fingerprints reaches the driver, to choose the vantage points. The sample
decides how evenly the shards are filled, never which links are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import first_by_hash, keep_rows, saved, whole_text

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
SAMPLE = 8192
"""Distinct fingerprints that the driver sees to choose vantage points from."""
FAN = 8
"""Distance ranges per vantage point."""
MOST_TASKS = 20_000
"""Tasks that compare shards, at most."""
LEAF = 256
"""Below so many points a shard compares directly."""


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of a text: majority bits of the XXH64 of its word shingles."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        count = len(words) - shingle_words + 1
        spans = zip(starts[:count].tolist(), ends[shingle_words - 1:].tolist())
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=count)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_sha256 and the fingerprint as a signed long, a row per document."""
    text = whole_text(text_column)
    wanted = docs.select(F.col(id_column).cast("bigint").alias("doc_id"),
                         F.sha2(F.encode(text, "utf-8"), 256).alias("text_sha256"), text.alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in part.column(2)),
                                 dtype=np.uint64, count=part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(values.view(np.int64))], names=["doc_id", "text_sha256", "fp"])

    return wanted.mapInArrow(batches, "doc_id bigint, text_sha256 string, fp bigint")


# -- the tree of shards ------------------------------------------------------------------------------

def _ranges(distances: np.ndarray, fan: int) -> list[tuple[int, int]]:
    """Up to ``fan`` ranges of distance with about equally many points; together they cover 0 to 64."""
    cuts = sorted({int(c) for c in np.quantile(distances, np.arange(1, fan) / fan, method="lower")})
    cuts = [c for c in cuts if c < distances.max()]
    edges = [-1, *cuts, 64]
    return [(low + 1, high) for low, high in zip(edges, edges[1:])]


def _vantage(points: np.ndarray, tries: int = 24) -> int:
    """The point whose distances spread the most."""
    candidates = points[:: max(1, len(points) // tries)][:tries]
    spread = np.bitwise_count(points[None, :] ^ candidates[:, None]).astype(np.float32).std(axis=1)
    return int(candidates[int(spread.argmax())])


def shard_tree(sample: np.ndarray, per_shard: float, fan: int = FAN) -> tuple[tuple | int, int]:
    """A tree of (vantage, [(low, high, subtree or shard number)]) and the number of shards."""
    shards = 0

    def grow(points: np.ndarray) -> tuple | int:
        nonlocal shards
        if len(points) > max(per_shard, 1):
            vantage = _vantage(points)
            distances = np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int64)
            parts = max(2, min(fan, round(len(points) / max(per_shard, 1))))
            ranges = _ranges(distances, parts)
            if len(ranges) > 1:
                return (vantage, [
                    (low, high, grow(points[(distances >= low) & (distances <= high)])) for low, high in ranges])
        shards += 1
        return shards - 1

    return grow(np.sort(sample)), shards


def _routed(tree: tuple | int, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indexes of points that live or ask there, whether they live there)."""
    stack = [(tree, np.arange(len(points)), np.ones(len(points), dtype=bool))]
    while stack:
        node, index, home = stack.pop()
        if not len(index):
            continue
        if isinstance(node, int):
            yield node, index, home
            continue
        vantage, children = node
        distances = np.bitwise_count(points[index] ^ np.uint64(vantage)).astype(np.int64)
        for low, high, child in children:
            near = (distances >= low - radius) & (distances <= high + radius)
            inside = (distances >= low) & (distances <= high)
            stack.append((child, index[near], (home & inside)[near]))


def _asks(home: np.ndarray, shard: int) -> np.ndarray:
    """Whether points that live in ``home`` ask ``shard``: one direction for each pair of shards, evenly dealt."""
    return np.where((home + shard) % 2 == 0, home < shard, home > shard)


# -- links inside a shard ----------------------------------------------------------------------------

class _Forest:
    """Groups of indexes under links that arrive in arrays."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))

    def find(self, of: np.ndarray) -> np.ndarray:
        up = self.root[of]
        while True:
            further = self.root[up]
            if np.array_equal(further, up):
                self.root[of] = up
                return up
            up = further


def near_links(points: np.ndarray, inner: np.ndarray, outer: np.ndarray, radius: int) -> np.ndarray:
    """Group roots over ``points`` under every link between one of ``inner`` and one of ``outer`` (indexes)."""
    forest = _Forest(len(points))
    stack = [(inner, outer)]
    while stack:
        inner, outer = stack.pop()
        if not len(inner) or not len(outer):
            continue
        vantage, shells = np.uint64(0), np.zeros(1)
        if len(inner) > LEAF:
            vantage = np.uint64(_vantage(points[inner]))
            near = np.bitwise_count(points[inner] ^ vantage)
            shells = np.unique(near)
        if len(shells) == 1:
            step = max(1, (1 << 22) // len(inner))
            for at in range(0, len(outer), step):
                part = outer[at:at + step]
                a, b = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[inner][None, :]) <= radius)
                forest.link(part[a], inner[b])
            continue
        far = np.bitwise_count(points[outer] ^ vantage).astype(np.int16)
        # everything within the radius of the vantage point is linked to it, and so to each other; inner
        # points too, which need not be among the outer ones
        ball = np.concatenate([outer[far <= radius], inner[near <= radius]])
        forest.link(ball, np.full(len(ball), inner[np.argmin(near)]))
        for distance in shells.astype(int).tolist():
            close = np.abs(far - distance) <= radius
            if distance <= radius:
                close &= far > radius
            stack.append((inner[near == distance], outer[close]))
    return forest.find(np.arange(len(points)))


def near_edges(points: DataFrame, radius: int = RADIUS, slices: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, enough to connect every group, none wrong.

    What asks a shard is dealt to ``slices`` pieces, as many as the number of points needs if not given.
    """
    spark = points.sparkSession
    count = points.count()
    sample = first_by_hash(points.select("fp", F.xxhash64("fp").alias("hash")), "hash", SAMPLE, count)
    values = np.array([r["fp"] for r in sample], dtype=np.int64).view(np.uint64)
    # shards grow with the root of the number of points, and so does their number
    per_shard = max(512.0, 8 * count ** 0.5)
    tree, shards = shard_tree(values, per_shard * len(values) / max(count, 1))
    slices = slices or max(1, round(count / (64 * per_shard)))
    tree_sent = spark.sparkContext.broadcast(tree)

    def route(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            own = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            found = list(_routed(tree_sent.value, own, radius))
            homes = np.zeros(len(own), dtype=np.int64)
            for shard, index, home in found:
                homes[index[home]] = shard
            turn = ((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % slices
            for shard, index, home in found:
                for piece in range(slices):
                    mine = turn[index] == piece
                    sent = home | (mine & _asks(homes[index], shard))
                    role = np.where(home, np.where(mine, 2, 1), 0)[sent]
                    if sent.any():
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(sent.sum(), shard, dtype=np.int32)),
                            pa.array(np.full(sent.sum(), piece, dtype=np.int32)),
                            pa.array(own[index][sent].view(np.int64)), pa.array(role.astype(np.int32))],
                            names=["shard", "piece", "fp", "role"])

    def compare(rows: pa.Table) -> pa.Table:
        own = rows.column("fp").to_numpy()
        role = rows.column("role").to_numpy()
        # role 2: lives here and asks in this piece, 1: only lives here, 0: only asks
        roots = near_links(own.view(np.uint64), np.flatnonzero(role > 0), np.flatnonzero(role != 1), radius)
        linked = roots != np.arange(len(roots))
        return pa.table({"a": own[linked], "b": own[roots[linked]]})

    routed = points.select("fp").mapInArrow(route, "shard int, piece int, fp bigint, role int")
    # a task for each group: a group is much work for few bytes
    routed = routed.repartition(min(MOST_TASKS, shards * slices), "shard", "piece")
    return routed.groupBy("shard", "piece").applyInArrow(compare, "a bigint, b bigint")


# -- groups ------------------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node that it is connected to.

    Alternates two steps until nothing changes: every node links its larger neighbours, then its
    smaller ones, to the smallest node that it sees. Minima are aggregated before the shuffle, so that
    a node with very many links is no bottleneck.
    """
    current = saved(edges.where("a <> b").select(
        F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(), "links")
    state = None
    while True:
        both = current.unionByName(current.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = saved(both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("least")), "least")
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("least").alias("root"))
        large = saved(large.where("node <> root").distinct(), "large")
        least = saved(large.groupBy("node").agg(F.min("root").alias("least")), "least")
        small = large.join(least, "node")
        small = small.select(F.col("root").alias("node"), F.col("least").alias("root")).unionByName(
            small.select("node", F.col("least").alias("root"))).where("node <> root").distinct()
        current = saved(small, "links")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == state:
            return current
        state = now


def _grouped(docs: DataFrame, id_column: str, text_column: str, shingle_words: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Every row with its fingerprint, and every distinct fingerprint with the row that stays for its group."""
    prints = saved(fingerprints(docs, id_column, text_column, shingle_words), "fingerprints")
    row = F.struct(F.isnull("doc_id").alias("unknown"), "doc_id", "text_sha256")
    distinct = saved(prints.groupBy("fp").agg(F.min(row).alias("first")), "distinct-fingerprints")
    roots = components(near_edges(distinct, radius))
    placed = saved(distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "placed")
    # both sides written down: a join of plain shuffles, whose large groups Spark can split
    smallest = saved(placed.groupBy("root").agg(F.min("first").alias("stays")), "smallest")
    return prints, saved(placed.drop("first").join(smallest, "root"), "components")


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits, the
    document's own included. A null or empty text has fingerprint zero, which links like any other.
    Rows that repeat a doc_id each count with their own text. A null doc_id takes part in links and is
    never the smallest, unless its group has no other. Other columns are ignored. No rows give no rows.
    """
    prints, groups = _grouped(docs, id_column, text_column, shingle_words, radius)
    return prints.join(groups, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("stays.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                         shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each group, with all its columns: the smallest doc_id, then the smallest digest."""
    _, groups = _grouped(docs, id_column, text_column, shingle_words, radius)
    keepers = groups.where("fp = root").select(
        F.col("stays.doc_id").alias("keep_doc"), F.col("stays.text_sha256").alias("keep_sha"))
    return keep_rows(docs, keepers, id_column, text_column)
