"""Helpers that several operators share."""

from pyspark.sql import functions as F

from gridloom.llm.common import first_by_hash, free_name


def test_first_by_hash_is_the_sorted_head(spark):
    rows = spark.range(0, 5000, 1, 7).select("id", F.xxhash64("id").alias("hash"))
    want = [r.id for r in rows.orderBy("hash").limit(40).collect()]
    assert [r.id for r in first_by_hash(rows, "hash", 40)] == want
    assert len(first_by_hash(rows, "hash", 9000)) == 5000
    assert first_by_hash(rows.limit(0), "hash", 3) == []
    # all hashes above the first bound
    high = rows.where("hash > 9000000000000000000")
    assert len(first_by_hash(high, "hash", 20)) == min(20, high.count())


def test_free_name(spark):
    rows = spark.createDataFrame([(1, 2)], "A int, a_1 int")
    assert (free_name(rows, "a"), free_name(rows, "b")) == ("a_2", "b")
