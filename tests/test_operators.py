import random

import pytest

from pyspark.sql import functions as F

from conftest import rows
from gridloom.operators import compare as cmp
from gridloom.operators.browse import facets, filtered_count, page, value_filter
from gridloom.operators.compare import compare, status_counts
from gridloom.operators.duplicates import duplicate_rows, duplicate_summary
from gridloom.operators.join import join_tables, output_names


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [("a@example.com", "Ada"), ("b@example.com", "Ola"), ("a@example.com", "Adam")], "Email string, Name string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "Id long")


# Duplicates

def test_summary_and_rows(people):
    assert rows(duplicate_summary(people, ["email"])) == [("a@example.com", 2)]
    assert rows(duplicate_rows(people, ["Email"])) == [("a@example.com", "Ada"), ("a@example.com", "Adam")]


def test_empty_keys(spark):
    df = spark.createDataFrame([("", "Ada"), (" ", "Eva"), ("", "Ola"), ("valid@example.com", "Jan")], "Email string, Name string")
    assert duplicate_summary(df, ["Email"], ignore_empty=True).count() == 0
    assert duplicate_rows(df, ["Email"], ignore_empty=True).count() == 0
    assert rows(duplicate_summary(df, ["Email"])) == [("", 2)]


def test_every_key_must_be_present_when_ignoring_empty(spark):
    df = spark.createDataFrame([("a", ""), ("a", ""), ("a", "b"), ("a", "b"), (None, "b"), (None, "b")], "x string, y string")
    assert rows(duplicate_summary(df, ["x", "y"], ignore_empty=True)) == [("a", "b", 2)]
    assert rows(duplicate_summary(df, ["x", "y"])) == [(None, "b", 2), ("a", "", 2), ("a", "b", 2)]


def test_null_keys_are_reported_but_their_rows_are_not(spark):
    df = spark.createDataFrame([(k,) for k in ("a", "a", "b", None, None, "", "")], "k string")
    assert rows(duplicate_summary(df, ["k"])) == [(None, 2), ("", 2), ("a", 2)]
    assert rows(duplicate_rows(df, ["k"])) == [("",), ("",), ("a",), ("a",)]


def test_ordered_rows(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "b"), (4, "a")], "id long, k string")
    assert [tuple(r) for r in duplicate_rows(df, ["k"], ordered=True, tie_break="id").collect()] == [
        (1, "a"), (4, "a"), (2, "b"), (3, "b")]


def test_key_checks(people):
    with pytest.raises(ValueError):
        duplicate_summary(people, [])
    with pytest.raises(ValueError):
        duplicate_rows(people, ["Phone"])


def test_odd_column_names(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2)], "`a.b``c` string, `d e` int")
    assert rows(duplicate_summary(df, ["a.b`c"])) == [("x", 2)]
    assert duplicate_rows(df, ["a.b`c"]).count() == 2
    assert rows(value_filter(df, {"d e": ["2"]})) == [("x", 2)]
    assert join_tables(df, df, ["a.b`c"]).columns == ["a.b`c", "d e", "right_a.b`c", "right_d e"]


# Compare

def test_two_tables(spark):
    left = spark.createDataFrame([("a", "Ada"), ("b", "Ola")], "Email string, Name string")
    right = spark.createDataFrame([("a", "x"), ("c", "y")], "Mail string, Name string")
    pair = [(left, ["Email"]), (right, ["Mail"])]
    result = compare(pair)
    assert result.columns == ["Email", "in_1", "in_2", "status"]
    assert rows(result) == [
        ("a", True, True, "In all files"), ("b", True, False, "Only in: file 1"), ("c", False, True, "Only in: file 2")]
    assert [r[0] for r in rows(compare(pair, cmp.COMMON_ROWS))] == ["a"]
    assert [r[0] for r in rows(compare(pair, cmp.LEFT_ONLY))] == ["b"]
    assert [r[0] for r in rows(compare(pair, cmp.RIGHT_ONLY))] == ["c"]
    assert [r[0] for r in rows(compare(pair, cmp.DIFFERENT_ROWS))] == ["b", "c"]


def test_three_tables(spark):
    three = [(ids(spark, 1, 2, 4), ["Id"]), (ids(spark, 2, 3, 4), ["Id"]), (ids(spark, 2, 3, 5), ["Id"])]
    assert {r.Id: r.status for r in compare(three).collect()} == {
        1: "Only in: file 1", 2: "In all files", 3: "In files: file 2, file 3",
        4: "In files: file 1, file 2", 5: "Only in: file 3"}
    assert compare(three, cmp.RIGHT_ONLY).count() == 0
    assert {(r.status, r.key_count, r.total_keys) for r in status_counts(compare(three)).collect()} == {
        ("Only in: file 1", 1, 5), ("In all files", 1, 5), ("In files: file 2, file 3", 1, 5),
        ("In files: file 1, file 2", 1, 5), ("Only in: file 3", 1, 5)}


def test_null_key_is_listed_and_found_nowhere(spark):
    three = [(ids(spark, 1, 2, 4, None), ["Id"]), (ids(spark, 2, 3, 4, 4), ["Id"]), (ids(spark, 2, 3, 5, None), ["Id"])]
    empty = [r for r in compare(three).collect() if r.Id is None]
    assert [tuple(r) for r in empty] == [(None, False, False, False, "In files: ")]
    for mode in (cmp.COMMON_ROWS, cmp.LEFT_ONLY, cmp.RIGHT_ONLY):
        assert compare(three, mode).where("Id is null").count() == 0
    assert compare(three, cmp.DIFFERENT_ROWS).where("Id is null").count() == 1


def test_many_tables_and_mixed_key_types(spark):
    many = [(ids(spark, i, i + 1), ["Id"]) for i in range(70)]
    found = {r.Id: [i for i in range(70) if r[f"in_{i + 1}"]] for r in compare(many).collect()}
    assert found[0] == [0] and found[63] == [62, 63] and found[70] == [69] and len(found) == 71
    text = spark.createDataFrame([("1",), ("x",)], "Id string")
    assert rows(compare([(ids(spark, 1, 2), ["Id"]), (text, ["Id"])], cmp.COMMON_ROWS))[0][0] == "1"


def test_compare_argument_checks(spark):
    table = ids(spark, 1)
    for bad in ([(table, ["Id"])], [(table, ["Id"]), (table, ["Id"])], [(table, []), (ids(spark, 1), [])],
                [(table, ["Id"]), (ids(spark, 1), ["Id", "Id"])]):
        with pytest.raises(ValueError):
            compare(bad)
    with pytest.raises(ValueError):
        compare([(table, ["Id"]), (ids(spark, 1), ["Id"])], "sideways")


# Join

def test_join_kinds_and_names(spark):
    left = spark.createDataFrame([(1, "Ada"), (2, "Ola"), (None, "Nil")], "Id long, Name string")
    right = spark.createDataFrame([(2, "Warszawa"), (3, "Kraków"), (None, "Nic")], "Id long, City string")
    assert join_tables(left, right, ["Id"]).columns == ["Id", "Name", "right_Id", "City"]
    assert rows(join_tables(left, right, ["Id"])) == [(2, "Ola", 2, "Warszawa")]
    assert rows(join_tables(left, right, ["Id"], how="left")) == [
        (None, "Nil", None, None), (1, "Ada", None, None), (2, "Ola", 2, "Warszawa")]
    assert rows(join_tables(left, right, ["Id"], how="right")) == [
        (None, None, None, "Nic"), (None, None, 3, "Kraków"), (2, "Ola", 2, "Warszawa")]
    chosen = join_tables(left, right, ["Id"], how="left", left_columns=["name"], right_columns=["City"], ordered=True)
    assert [tuple(r) for r in chosen.collect()] == [("Nil", None), ("Ada", None), ("Ola", "Warszawa")]


def test_output_names():
    assert output_names(["Id", "id"], ["ID", "right_Id"]) == ["Id", "left_id", "right_ID", "right_right_Id"]
    assert output_names(["a", "a", "a"], []) == ["a", "left_a", "left_a_2"]


def test_join_with_itself_on_two_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "x int, y string")
    assert rows(join_tables(df, df, ["x", "y"])) == [(1, "a", 1, "a"), (1, "b", 1, "b"), (2, "a", 2, "a")]
    assert join_tables(df, df, ["x"]).count() == 5


def test_join_checks(people):
    with pytest.raises(ValueError):
        join_tables(people, people, [])
    with pytest.raises(ValueError):
        join_tables(people, people, ["Email"], ["Email", "Name"])
    with pytest.raises(ValueError):
        join_tables(people, people, ["Email"], left_columns=[], right_columns=[])
    with pytest.raises(ValueError):
        join_tables(people, people, ["Email"], how="cross")


# Browse

@pytest.fixture(scope="module")
def cities(spark):
    return spark.createDataFrame(
        [("Ada", "Warszawa", "Aktywny"), ("Ola", "Warszawa", "Nieaktywny"), ("Zen", "Kraków", "Aktywny"), ("Iga", None, "Aktywny")],
        "Name string, City string, Status string")


def test_filters(cities):
    assert rows(value_filter(cities, {"city": ["Warszawa"], "Status": ["Aktywny"]})) == [("Ada", "Warszawa", "Aktywny")]
    assert [r[0] for r in rows(value_filter(cities, {"City": [None, "Kraków"]}))] == ["Iga", "Zen"]
    assert value_filter(cities, {"City": []}).count() == 0
    assert filtered_count(cities, {"Status": ["Aktywny"]}).first().total_rows == 3
    with pytest.raises(ValueError):
        value_filter(cities, {"Street": ["x"]})


def test_filters_on_typed_columns(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 12.5D, true, timestamp'2024-01-05 00:00:00'), (2, 5D, false, NULL) t(i, d, b, ts)")
    assert [r.i for r in value_filter(df, {"i": ["2", "x"]}).collect()] == [2]
    assert [r.i for r in value_filter(df, {"d": ["12.50"]}).collect()] == [1]
    assert [r.i for r in value_filter(df, {"d": ["12.50"]}, as_text=True).collect()] == []
    assert [r.i for r in value_filter(df, {"d": ["5"]}, as_text=True).collect()] == [2]
    assert [r.i for r in value_filter(df, {"b": ["1"]}).collect()] == [1]
    assert [r.i for r in value_filter(df, {"ts": ["2024-01-05T00:00:00.0000000+00:00", None]}).collect()] == [1, 2]


def test_facets(cities):
    found = facets(cities, "Status", {"City": ["Warszawa"], "Status": ["Nieaktywny"]})
    assert [tuple(r) for r in found.collect()] == [("Aktywny", 1), ("Nieaktywny", 1)]
    assert [tuple(r) for r in facets(cities, "City").collect()] == [(None, 1), ("Kraków", 1), ("Warszawa", 2)]
    assert [tuple(r) for r in facets(cities, "City", search="WARS").collect()] == [("Warszawa", 2)]
    assert facets(cities, "Name", limit=2).count() == 2


def test_pages(spark):
    df = spark.createDataFrame([(i, i % 7 if i % 5 else None) for i in range(100)], "id long, k int")
    expected = sorted(((i, i % 7 if i % 5 else None) for i in range(100)), key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    got = page(df, "k", limit=10, offset=15, tie_break="id", numbered=True).collect()
    assert [(r.id, r.k) for r in got] == expected[15:25]
    assert [r.row_number for r in got] == list(range(16, 26))
    assert [r.id for r in page(df, "id", descending=True, limit=3, offset=-5).collect()] == [99, 98, 97]
    assert page(df, "id", offset=98).count() == 2
    with pytest.raises(ValueError):
        page(df, "id", limit=0)
    with pytest.raises(ValueError):
        page(df, "nope")


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["double", "string", "timestamp"])
def test_deep_pages(spark, descending, kind):
    rnd = random.Random(7)
    data = []
    for i in range(3000):
        draw = rnd.random()
        # A third of the rows share one key, and some have none.
        data.append((i, None if draw < 0.1 else 50 if draw < 0.45 else rnd.randrange(100)))
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "id long, n int").selectExpr(
        "id", f"cast({ {'double': 'n / 8D', 'string': 'lpad(n, 3, 0)', 'timestamp': 'timestamp_seconds(n * 86400)'}[kind] } as {kind}) AS k")
    order = sorted(data, key=lambda r: r[0])
    order = sorted(order, key=lambda r: (r[1] is not None, r[1] or 0), reverse=False)
    if descending:
        order = sorted(sorted(data, key=lambda r: r[0]), key=lambda r: (r[1] is None, -(r[1] or 0)))
    for offset in (0, 95, 1200, 2990, 5000):
        got = page(df, "k", descending, limit=20, offset=offset, tie_break="id", top_k_rows=100).collect()
        assert [r.id for r in got] == [r[0] for r in order[offset:offset + 20]], (offset, descending)


# Plans

def test_plans_stay_in_the_jvm(spark, people):
    for df in (
        duplicate_summary(people, ["Email"]), duplicate_rows(people, ["Email"]),
        compare([(people, ["Email"]), (people.select("Email"), ["Email"])]),
        join_tables(people, people, ["Email"], how="left"),
    ):
        text = plan(df)
        assert "Python" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_compare_needs_one_shuffle(spark):
    text = plan(compare([(ids(spark, 1), ["Id"]), (ids(spark, 2), ["Id"]), (ids(spark, 3), ["Id"])]))
    assert text.count("Exchange") == 1 and "Join" not in text


@pytest.mark.parametrize("how,kept", [("left", "_l"), ("right", "_r")])
def test_null_keys_do_not_meet_in_one_task(spark, how, kept):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    previous = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = spark.createDataFrame([(i if i % 3 else None, i) for i in range(300)], "k long, v long")
        joined = join_tables(df, df, ["k"], how=how)
        exchanges = [line for line in plan(joined).splitlines() if "Exchange hashpartitioning" in line]
        assert len(exchanges) == 2 and all("part#" in line for line in exchanges)
        assert joined.count() == 300 and joined.where("k IS NULL AND right_k IS NULL").count() == 100
        tasks = joined.where(f"{'v' if how == 'left' else 'right_v'} % 3 = 0").groupBy(F.spark_partition_id()).count()
        assert tasks.count() > 1
    finally:
        for key, value in previous.items():
            spark.conf.set(key, value)


@pytest.mark.parametrize("descending, tie", [(False, "k"), (True, "k"), (False, None), (True, None)])
def test_fences_give_the_pages_of_a_sort(spark, descending, tie):
    from gridloom.operators.fences import Fences

    chance = random.Random(4)
    data = [(chance.choice([None, -2.5, 1.0, 1.5, 1e300]) if n % 3 else float(n % 50), f"k{n:04d}") for n in range(1500)]
    table = spark.createDataFrame(data, "v double, k string").repartition(5)
    order = sorted(sorted(data, key=lambda r: r[1]), key=lambda r: (r[0] is not None, r[0] or 0), reverse=descending)
    fences = Fences.build(table, "v", descending, tie, fence_rows=40)
    for offset in (0, 39, 40, 700, 1111, 1490, 1500, 9000):
        got = [(r.v, r.k) for r in fences.page(25, offset).collect()]
        want = order[offset:offset + 25]
        assert got == want if tie else [v for v, _ in got] == [v for v, _ in want]
    again = Fences(table, fences.fences.inputFiles()[0].rsplit("/", 1)[0], "v", descending, tie)
    assert [r.row_number for r in again.page(5, 800, numbered=True).collect()] == list(range(801, 806))


def test_fences_reach_the_scan(spark, folder):
    from gridloom.operators.fences import Fences

    spark.range(5000).write.parquet(folder.new("t"))
    fences = Fences.build(spark.read.parquet(folder.new("t")), "id", tie_break="id", fence_rows=100)
    page = fences.page(20, 3030)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,3000)" in plan and "LessThanOrEqual(id,3100)" in plan
    assert [r.id for r in page.collect()] == list(range(3030, 3050))
