"""Best-fit packing of tokenized documents into sequences of fixed length, with swap-based local search.

Every document becomes pieces of at most ``capacity`` tokens. Full pieces are sequences of their own.
The others are dealt to shards by a hash; a shard packs its pieces best fit, largest first, and then
improves the packing: pieces move between underfull sequences, one for none, one for one or two for
one, whenever that raises the sum of squared fills, until sequences run empty. What is still far from
full goes into another round with fewer shards, so the waste does not grow with their number.

Sizes and ids take part in the search, not tokens. A shard's size is bounded by ``SHARD_PIECES``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import saved, whole_text

CAPACITY = 1024
END_ID = 2
SHARD_PIECES = 8192
"""Pieces that one task packs, about."""
OPEN_BELOW = 0.97
"""Sequences filled less than this are packed again in the next round."""
MOST_TASKS = 20_000
"""Tasks that pack shards, at most."""
LONG_RUN = 1 << 16
"""Runs of white space from this length on are cut out before the tokenizer's pattern, whose matcher steps back
over a run, a stack frame for each character."""
# white space as the tokenizer's pattern has it, which is not that of Python's \s
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def default_tokenizer() -> str:
    """Where this installation has the public byte-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Encoder:
    """Ids of a byte-level BPE file of the tokenizers library.

    The same merges run in tiktoken, several times as fast; the few texts that spell an added token
    go through the library itself, which gives those strings ids of their own.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        added = [t["content"] for t in vocabulary.get("added_tokens", [])]
        # printable bytes stand for themselves, the others for the code points from 256 on, in order
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocabulary["model"]["vocab"].items() if piece not in added}
        import public_tokenizers

        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.added, self.slow = path, added, None

    def __call__(self, text: str) -> np.ndarray:
        if any(token in text for token in self.added):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if len(text) < LONG_RUN:
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        found, at = [], 0
        for run in _LONG_RUN.finditer(text):
            # all of a run but its last character is one piece of the pattern; at the end of a text, the whole run
            start, stop = run.start(), run.end() if run.end() == len(text) else run.end() - 1
            found += [self.fast.encode_ordinary(text[at:start]), self.fast._encode_single_piece(text[start:stop])]
            at = stop
        found.append(self.fast.encode_ordinary(text[at:]))
        return np.concatenate([np.array(ids, dtype="<u4") for ids in found])


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None,
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the end id, cut where they must be.

    A longer document's first piece takes what is left over when all others are full.
    """
    path = tokenizer or default_tokenizer()
    wanted = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), whole_text(text_column).alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _Encoder(path)
        end = np.array([end_id], dtype="<u4")
        for part in parts:
            found = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                ids = np.concatenate([encode(text.as_py()), end])
                stops = range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
                start = 0
                for number, stop in enumerate(stops):
                    found.append((doc, number, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    start = stop
            columns = list(zip(*found)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32())]
                + [pa.array(c, pa.int64()) for c in columns[2:]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return wanted.mapInArrow(batches, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


# -- packing one shard -------------------------------------------------------------------------------

def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indexes: largest first, each into the bin that it leaves least room in."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, len(bins)
            bins.append([])
        bins[chosen].append(item)
        by_room[room - size].append(chosen)
        rooms |= 1 << (room - size)
    return bins


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Exchanges pieces between underfull bins while that raises the sum of squared fills.

    The emptiest bin gives: one of its pieces moves to a fuller bin, or changes places with a smaller
    one there, or two of them with one. Of all exchanges that fit, the one that raises the sum most is
    made. A bin that can give nothing is left; one that runs empty is dropped. Every exchange raises the
    sum, which is bounded, so the search ends by itself, when no bin can give.
    """
    fills = [int(sum(sizes[i] for i in b)) for b in bins]
    full = [b for b, fill in zip(bins, fills) if fill >= capacity]
    part = [list(b) for b, fill in zip(bins, fills) if fill < capacity]
    fill = np.array([f for f in fills if f < capacity], dtype=np.int64)
    owner = np.array([k for k, b in enumerate(part) for _ in b], dtype=np.int64)
    item = np.array([i for b in part for i in b], dtype=np.int64)
    size = sizes[item].astype(np.int64) if len(item) else np.zeros(0, dtype=np.int64)
    waiting = np.ones(len(part), dtype=bool)
    while waiting.any():
        giver = int(np.where(waiting & (fill > 0), fill, capacity + 1).argmin())
        if not waiting[giver] or fill[giver] <= 0:
            break
        mine = np.flatnonzero(owner == giver)
        best = (0, None, None, -1)
        # one for none: any other bin, as if it gave a piece of size zero
        gives = [((int(m),), int(size[m])) for m in mine]
        gives += [((int(a), int(b)), int(size[a] + size[b])) for x, a in enumerate(mine) for b in mine[x + 1:]]
        for given, total in gives:
            for taken_size, taken_bin, kind in ((0, np.arange(len(fill)), "move"), (size, owner, "swap")):
                if kind == "move" and len(given) > 1:
                    continue
                more = total - taken_size
                ok = (more > 0) & (fill[taken_bin] + more <= capacity) & (taken_bin != giver) & (fill[taken_bin] > 0)
                gain = np.where(ok, 2 * more * (fill[taken_bin] - fill[giver] + more), 0)
                at = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[at] > best[0]:
                    best = (int(gain[at]), given, at if kind == "swap" else None, int(taken_bin[at]))
        gain, given, taken, receiver = best
        if gain <= 0:
            waiting[giver] = False
            continue
        moved = int(size[list(given)].sum()) - (int(size[taken]) if taken is not None else 0)
        owner[list(given)] = receiver
        if taken is not None:
            owner[taken] = giver
        fill[giver] -= moved
        fill[receiver] += moved
        waiting[giver] = fill[giver] > 0
        if fill[receiver] < capacity:
            waiting[receiver] = True
    order = np.argsort(owner, kind="stable")
    groups = np.split(item[order], np.flatnonzero(np.diff(owner[order])) + 1) if len(item) else []
    return full + [g.tolist() for g in groups]


def _pack(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Places of the pieces of one shard. A sequence is named by the smallest of its piece ids."""
    rows = rows.sort_values("piece_id", ignore_index=True)
    sizes, ids = rows["length"].to_numpy(), rows["piece_id"].to_numpy()
    sequence, offset, fill = (np.zeros(len(rows), dtype=np.int64) for _ in range(3))
    for content in local_search(best_fit(sizes, capacity), sizes, capacity):
        content = np.sort(np.array(content))
        ends = np.cumsum(sizes[content])
        sequence[content], offset[content], fill[content] = ids[content].min(), ends - sizes[content], ends[-1]
    return pd.DataFrame({"piece_id": ids, "length": sizes, "sequence_id": sequence, "offset": offset, "fill": fill})


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a document of the end id alone. Rows that repeat a doc_id are packed as
    documents of their own; a null doc_id stays null. Other columns are ignored. No rows give no rows.
    Equal sizes are taken in the order of the written pieces.
    """
    every = saved(pieces(docs, capacity, end_id, tokenizer, id_column, text_column)
                  .withColumn("piece_id", F.monotonically_increasing_id()), "pieces")
    left = every.where(F.col("length") < capacity).select("piece_id", "length")
    places = [every.where(F.col("length") >= capacity).select(
        "piece_id", F.col("piece_id").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    count, rounds = left.count(), 0
    while count:
        shards = max(1, round(count / SHARD_PIECES))
        shard = F.pmod(F.xxhash64("piece_id", F.lit(rounds)), F.lit(shards))
        # a task for each shard: a shard is much work for few bytes
        dealt = left.withColumn("shard", shard).repartition(min(MOST_TASKS, shards), "shard")
        packed = saved(dealt.groupBy("shard").applyInPandas(
            lambda rows: _pack(rows, capacity),
            "piece_id bigint, length bigint, sequence_id bigint, offset bigint, fill bigint"), "packed")
        again = F.col("fill") < OPEN_BELOW * capacity
        left = packed.where(again).select("piece_id", "length")
        remaining = left.count()
        # another round pays while it mixes the leftovers of several shards into fewer
        last = shards == 1 or round(remaining / SHARD_PIECES) > shards // 2
        places.append((packed if last else packed.where(~again)).select("piece_id", "sequence_id", "offset"))
        count, rounds = 0 if last else remaining, rounds + 1
    placed = places[0]
    for part in places[1:]:
        placed = placed.unionByName(part)
    return every.join(placed, "piece_id").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
