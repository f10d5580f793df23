"""Exact dedup and SimHash groups against brute force, and their edge cases."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, simhash

LONG = "word " * 30_000
ROWS = [
    (1, "same text"), (2, "same text"), (5, "same text"), (3, "same texT"), (4, None), (6, ""), (7, "x"), (8, LONG), (9, LONG),
    (10, LONG + "y"), (None, "same text"), (None, "only null"), (None, "only null"), (7, "x"), (11, "é" * 3000), (12, "é" * 3000),
]


def docs(spark, rows=ROWS):
    # extra columns whose names the operators use themselves
    return spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "doc_id long, text string, name string, row_id int, fp int")


def test_exact_groups(spark):
    found = exact_dedup.exact_groups(docs(spark), block_bytes=64).collect()
    assert len(found) == len(ROWS)
    groups = {}
    for doc, text in ROWS:
        groups.setdefault(text or "", []).append(doc)
    import hashlib

    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for row in found:
        ids = by_sha[row.text_sha256]
        assert row.group_size == len(ids)
        assert row.keep_id == max((i for i in ids if i is not None), default=None)
    for sha, ids in by_sha.items():
        kept = [r for r in found if r.text_sha256 == sha and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id


@pytest.mark.parametrize("block_bytes", [1, 3, 7])
def test_names_do_not_collide(spark, block_bytes):
    chance = random.Random(3)
    rows = [(i, "".join(chance.choice("ab") for _ in range(chance.randint(0, 9)))) for i in range(150)]
    found = exact_dedup.exact_groups(docs(spark, rows), block_bytes=block_bytes).collect()
    keep = {}
    for i, text in rows:
        keep[text] = max(keep.get(text, -1), i)
    assert {r.doc_id: r.keep_id for r in found} == {i: keep[t] for i, t in rows}


def test_colliding_keys_fall_back_to_blocks(spark):
    weak = lambda block: F.substr(block, F.lit(1), F.lit(1))
    rows = [(1, "ax"), (2, "ay"), (3, "ax"), (4, "b")]
    found = exact_dedup.exact_groups(docs(spark, rows), keys=(weak, exact_dedup._block_key)).collect()
    assert {r.doc_id: r.keep_id for r in found} == {1: 3, 2: 2, 3: 3, 4: 4}


def test_dropped_rows_keep_their_columns(spark):
    kept = exact_dedup.drop_exact_duplicates(docs(spark))
    assert kept.columns == docs(spark).columns
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()))
    assert got == sorted([(False, 5, "same text"), (False, 3, "same texT"), (False, 6, ""), (False, 7, "x"), (False, 9, LONG),
                          (False, 10, LONG + "y"), (True, 0, "only null"), (False, 12, "é" * 3000)])


def test_empty_tables(spark):
    none = docs(spark).limit(0)
    for made in (exact_dedup.exact_groups(none), exact_dedup.drop_exact_duplicates(none),
                 simhash.simhash_groups(none), simhash.drop_near_duplicates(none)):
        assert made.collect() == []


# -- SimHash -----------------------------------------------------------------------------------------

def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(values, radius):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def near_copies(count=220, seed=1):
    chance = random.Random(seed)
    rows = []
    for i in range(count):
        if i % 4 and rows:
            words = rows[chance.randrange(len(rows))][1].split(" ")
            for _ in range(chance.randint(0, 2)):
                words[chance.randrange(len(words))] = f"new{i}"
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(f"w{chance.randint(0, 60)}" for _ in range(chance.choice([0, 1, 3, 4, 40, 300])))))
    return rows


def test_simhash_groups(spark):
    rows = [*near_copies(), (900, None), (901, " \t\n"), (902, "One  TWO\vthree"), (903, "one two three"), (904, "Éa b"), (905, "éa b")]
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_roots(prints, 4)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs(spark, rows)).collect()}
    assert found == {i: (f"{p:016x}", rows[root][0]) for (i, _), p, root in zip(rows, prints, roots)}
    assert len(set(roots)) < len(rows) - 20
    kept = simhash.drop_near_duplicates(docs(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted({rows[r][0] for r in roots})


def test_simhash_repeated_and_null_ids(spark):
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (9, LONG), (None, "lone one here")]
    found = simhash.simhash_groups(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found) == [
        ("4", "4"), ("4", "4"), ("9", "9"), ("None", "4"), ("None", "None")]
    assert sorted(str(r.doc_id) for r in simhash.drop_near_duplicates(docs(spark, rows)).collect()) == ["4", "9", "None"]


def clustered_prints(count, seed):
    """Fingerprints of which a third lie around one point."""
    chance = np.random.default_rng(seed)
    far = chance.integers(0, 2**63, size=count * 2 // 3, dtype=np.uint64)
    near = np.full(count // 3, 0x1234567890ABCDEF, dtype=np.uint64)
    for _ in range(4):
        near ^= np.uint64(1) << chance.integers(0, 64, size=len(near)).astype(np.uint64)
    some = far[: count // 12] ^ (np.uint64(7) << chance.integers(0, 60, size=count // 12).astype(np.uint64))
    return np.unique(np.concatenate([far, near, some]))


def numpy_roots(values, radius):
    forest = simhash._Forest(len(values))
    for at in range(0, len(values), 512):
        a, b = np.nonzero(np.bitwise_count(values[at:at + 512, None] ^ values[None, :]) <= radius)
        forest.link(a + at, b)
    return forest.find(np.arange(len(values)))


def test_local_tree_finds_every_group():
    values = clustered_prints(3000, 2)
    every = np.arange(len(values))
    assert np.array_equal(simhash.near_links(values, every, every, 4), numpy_roots(values, 4))


def test_shards_find_every_group(spark, monkeypatch):
    values = clustered_prints(6000, 3)
    monkeypatch.setattr(simhash, "SAMPLE", 1500)
    table = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    tree, shards = simhash.shard_tree(np.sort(values)[::4], 100)
    assert shards > 8
    edges = simhash.near_edges(table, 4)
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    signed = values.view(np.int64).tolist()
    groups = {}
    for value, root in zip(signed, numpy_roots(values, 4).tolist()):
        groups.setdefault(root, []).append(value)
    want = {v: min(g) for g in groups.values() if len(g) > 1 for v in g if v != min(g)}
    assert found == want
    # links inside a shard are a forest, not all pairs
    assert edges.count() < 8 * len(values)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (200, 200)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 101: 100}
