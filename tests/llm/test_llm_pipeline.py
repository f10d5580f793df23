"""The pipeline against its stages done by brute force, and the registered queries against their SQL."""

import collections

import duckdb
import pytest

import corpus_pipeline
from check_queries import TABLES, sorted_rows
from gridloom.llm import decontaminate
from gridloom.llm.common import keep_rows
from gridloom.llm.queries import ORACLES, QUERIES
from test_llm_dedup import plain_fingerprint, plain_roots
from test_llm_filters import plain_found
from test_llm_texts import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    result = db.execute(ORACLES[name])
    names = [column[0] for column in result.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted_rows(df.columns, map(tuple, df.collect())) == sorted_rows(names, result.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_covers_its_table(spark, name):
    source, key = ("pages", "page_id") if "html" in name else ("documents", "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(key).collect()}
    assert {r[0] for r in QUERIES[name](spark, SF).select(key).collect()} == ids


def test_stages(spark):
    from gridloom.llm.common import saved

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = saved(stage(spark, docs, SF), "stage")
        if name == "best-fit packing":
            check_packing(after.collect(), before)
            break
        assert after.columns == columns
        kept = {r.doc_id: r.text for r in after.collect()}
        assert all(before[i] == t for i, t in kept.items())
        if name == "quality classifier":
            judged = [(i in kept) == bool(labels[i]) for i in before if i in labels]
            assert sum(judged) / len(judged) > 0.95
        elif name == "exact dedup":
            largest = collections.defaultdict(int)
            for i, t in before.items():
                largest[t] = max(largest[t], i)
            assert set(kept) == set(largest.values())
        elif name == "simhash near-dedup":
            ids = sorted(before)
            roots = plain_roots([plain_fingerprint(before[i]) for i in ids], 4)
            assert set(kept) == {ids[r] for r in roots}
        else:
            assert set(kept) == {i for i, t in before.items() if not plain_found(t, items)}
        docs = after
    assert decontaminate.MIN_SHARE * 5 == 4


def test_run_is_the_stages(spark):
    from gridloom.llm.common import table

    docs = table(spark, SF, "documents")
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert docs.count() >= 200


def test_keep_rows_ranks_repeated_rows(spark):
    import hashlib

    docs = spark.createDataFrame([(1, "a", "z"), (1, "a", "b"), (1, "c", "q"), (2, "a", "q"), (None, "a", "n"), (None, "a", None)],
                                 "doc_id long, text string, keep_doc string")
    sha = hashlib.sha256(b"a").hexdigest()
    keepers = spark.createDataFrame([(1, sha), (None, sha)], "keep_doc long, keep_sha string")
    got = keep_rows(docs, keepers).collect()
    assert sorted((str(r.doc_id), r.text, str(r.keep_doc)) for r in got) in (
        [("1", "a", "b"), ("None", "a", "n")], [("1", "a", "b"), ("None", "a", "None")])
