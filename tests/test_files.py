"""Files that are not plain: quotes, headers, broken ones; scripts, pages and compaction beside them."""

import csv
import io
import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gridloom.operators.browse import page, value_filter
from gridloom.operators.ingest import ColumnMapping, Staged, ingest, ingest_by_layout, preview, resolve_mappings
from gridloom.plans.sqltext import spark_text, statements
from gridloom.plans.workspace import Workspace
from gridloom.sinks.materialize import compact
from gridloom.sources.delimited import Dialect, open_quote_patterns, quote_code, read_records
from gridloom.sources.dialect import describe_head, profile
from gridloom.streaming.watch import watch_any, watch_folder, watched, watched_layouts


def inside_after(line, inside, delimiter=";"):
    """Character by character: whether a line ends inside a quoted cell."""
    at, start = 0, not inside
    while at < len(line):
        ch = line[at]
        if inside:
            if ch == '"' and line[at + 1:at + 2] == '"':
                at += 1
            elif ch == '"':
                inside, start = False, False
        elif ch == '"' and start:
            inside = True
        else:
            start = ch == delimiter
        at += 1
    return inside


def test_quote_states(spark):
    chance = random.Random(7)
    lines = ["", '"', '""', '"""', 'a"b', '"a";"b', 'x;"', '5" p;"q"', '"a"b";c', '"a"";"', ";" * 3000 + '"', '"' + "a" * 100_000]
    lines += ["".join(chance.choice('";ab') for _ in range(chance.randint(0, 12))) for _ in range(3000)]
    outside, inside = (re.compile(p) for p in open_quote_patterns(";"))
    got = {r.raw: r.code for r in spark.createDataFrame([(x,) for x in set(lines)], "raw string").withColumn("code", quote_code(F.col("raw"), ";")).collect()}
    for line in set(lines):
        want = inside_after(line, False) + 2 * inside_after(line, True)
        assert got[line] == want, line
        assert (outside.match(line) is not None) + 2 * (inside.match(line) is not None) == want


def test_records_over_many_splits(spark, folder):
    chance = random.Random(3)
    table = [[str(i), "".join(chance.choice('ab";\n ') for _ in range(chance.randint(0, 60)))] for i in range(3000)]
    out = io.StringIO()
    csv.writer(out, delimiter=";", lineterminator="\r\n").writerows([["id", "text"], *table])
    name = folder("many.csv", out.getvalue())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        found = ingest(spark, name, folder.new("staged"), trim=False)
        assert rows(found.accepted()) == sorted((tuple(r) for r in table), key=lambda r: [(True, c) for c in r])
        assert found.rejected().isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_spanning_records_move_no_whole_text(spark, folder):
    name = folder("a.csv", 'id;text\n1;"a\nb"\n2;c\n')
    dialect = Dialect.named("id", "text", delimiter=";", quoted_newlines=True)
    plan = read_records(spark, name, dialect)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan text") <= 2
    # what is exchanged are the pieces of records that cross a split
    for exchange in re.findall(r"Exchange hashpartitioning.*", plan):
        above = plan[plan.index(exchange):]
        assert re.search(r"_piece#\d+ = 0\)", above[:2500]) is None or "NOT (_piece" in above[:2500]


def test_bare_quotes_keep_their_rows(spark, folder):
    lines = [f"{i};x{i}" for i in range(70)] + ['70;5" pipe', "71;x", '72;6" pipe', '73;"q;uoted"', '74;a "b" c']
    found = ingest(spark, folder("q.csv", "Id;Size\n" + "\n".join(lines) + "\n"), folder.new("staged"))
    assert found.accepted().count() == 75 and found.rejected().isEmpty()
    assert {r.Id: r.Size for r in found.accepted().where("Id >= 70").collect()} == {
        "70": '5" pipe', "71": "x", "72": '6" pipe', "73": "q;uoted", "74": 'a "b" c'}


@pytest.mark.parametrize("header", ['"Id";"Na\r\nme"', ' Id ;"Na\nme"'])
def test_header_with_line_break(spark, folder, header):
    found = ingest(spark, folder("h.csv", header + "\r\n1;a\r\n2;b\r\n"), folder.new("staged"))
    assert rows(found.accepted()) == [("1", "a"), ("2", "b")]


def test_header_is_the_first_record(spark, folder):
    for name in ("a", "b"):
        folder(f"in/{name}.csv", f"{name}1;{name}2\nId;Name\n1;x\n")
    found = ingest(spark, folder.root + "/in", folder.new("staged"), Dialect(("Id", "Name"), ";"))
    # the same text further down is data
    assert rows(found.accepted()) == [("1", "x"), ("1", "x"), ("Id", "Name"), ("Id", "Name")]
    assert [(r.row_count, r.rejected_count) for r in found.manifest().collect()] == [(2, 0), (2, 0)]
    assert rows(Staged.open(spark, folder.new("staged")).accepted()) == rows(found.accepted())


def test_repeated_header_is_data_and_one_scan(spark, folder):
    found = ingest(spark, folder("a.csv", "Id;Name\n1;x\nId;Name\n2\n"), folder.new("staged"), Dialect.named("Id", "Name", delimiter=";"))
    assert rows(found.accepted()) == [("1", "x"), ("Id", "Name")]
    assert [r.row_number for r in found.rejected().collect()] == [4]
    plan = found.accepted()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_empty_files_are_listed(spark, folder):
    folder("in/a.csv", "Id;Name\n1;x\n")
    folder("in/b.csv", "")
    folder("in/c.csv", "\n\n\n")
    for number, dialect in enumerate([None, Dialect.named("Id", "Name", delimiter=";")]):
        found = ingest(spark, folder.root + "/in", folder.new(f"staged{number}"), dialect)
        manifest = {r.source_file.rsplit("/", 1)[-1]: (r.row_count, r.problem) for r in found.manifest().collect()}
        assert manifest["a.csv"] == (1, None)
        assert {n for n, (count, problem) in manifest.items() if problem and not count} == {"b.csv", "c.csv"}
        assert sorted(r.row_number is None for r in found.rejected().collect()) == [True, True]
    listed = profile(spark, folder.root + "/in").where("problem IS NOT NULL").collect()
    assert sorted(r.source_file.rsplit("/", 1)[-1] for r in listed) == ["b.csv", "c.csv"]


def test_failed_ingest_leaves_nothing(spark, folder):
    folder("in/a.csv", "Id;Name\n1;x\n")
    with pytest.raises(ValueError):
        ingest(spark, folder.root + "/in", folder.new("staged"), mappings=[ColumnMapping(9, "x")])
    import os

    assert not [n for n in os.listdir(folder.root) if n.startswith("staged")]


def test_head_beyond_its_first_lines(spark, folder):
    folder("in/a.csv", "\n" * 500 + "Id;Name\n1;x\n2;y\n")
    folder("in/b.csv", 'Id;"Na' + "\n" * 300 + 'me"\n1;x\n2;y\n')
    found = {tuple(r.column_names): r for r in profile(spark, folder.root + "/in").collect()}
    assert len(found) == 2 and all(r.has_header and r.problem is None for r in found.values())
    tables = ingest_by_layout(spark, folder.root + "/in", folder.new("tables"))
    assert [rows(t.accepted()) for t in tables.values()] == [[("1", "x"), ("2", "y")]] * 2


def test_describe_head_of_unfinished_lines():
    assert describe_head("f", "utf-8", True, ["a;b", '1;"x'], True, True, more=True)[-1] is True
    assert describe_head("f", "utf-8", True, ["a;b", '1;"x'], True, True)[8] == ["a", "b"]


def test_unreadable_files_do_not_stop_a_watch(spark, folder):
    folder("in/a.csv", "Id;Name\n1;x\n")
    folder("in/b.csv", "Id;Name\n2;y\n")
    # a checksum beside the file that is not the file's
    folder("in/.b.csv.crc", b"crc\x00\x00\x00\x02\x00\x01\x02\x03\x04")
    dialect = Dialect.named("Id", "Name", delimiter=";")
    watch_folder(spark, folder.root + "/in", folder.new("t"), folder.new("c"), dialect, once=True).awaitTermination()
    found = watched(spark, folder.new("t"))
    assert rows(found.accepted()) == [("1", "x")]
    assert [(r.source_file.rsplit("/", 1)[-1], "cannot be read" in r.message) for r in found.rejected().collect()] == [("b.csv", True)]
    watch_any(spark, folder.root + "/in", folder.new("any"), folder.new("c2"), once=True).awaitTermination()
    layouts = watched_layouts(spark, folder.new("any"))
    assert rows(layouts.pop("problems").rejected().select("row_number")) == [(None,)]
    assert [rows(t.accepted()) for t in layouts.values()] == [[("1", "x")]]


def test_preview_of_a_quote_that_never_closes(spark, folder):
    text = 'Id;Name\n1;"x\n' + "2;y\n" * 50_000
    shown = preview(spark, folder("p.csv", text), Dialect.named("Id", "Name", delimiter=";", quoted_newlines=True))
    assert shown.count() >= 1


def test_mapping_faults_are_all_named():
    with pytest.raises(ValueError) as error:
        resolve_mappings([ColumnMapping(5, "a"), ColumnMapping(0, " "), ColumnMapping(0, "b", "Colour")], ["x"])
    assert all(part in str(error.value) for part in ("'a'", "blank", "Colour"))


# -- tables ------------------------------------------------------------------------------------------

def test_compact_keeps_partition_values_to_the_letter(spark, folder):
    target = folder.new("t")
    table = spark.range(40).select("id", F.format_string("0%d", F.col("id") % 3).alias("p"), F.when(F.col("id") % 2 == 0, "a b").alias("q"))
    table.repartition(8).write.partitionBy("p", "q").parquet(target)
    import os

    before = sorted(os.listdir(target))
    result = compact(spark, target).first()
    assert result.same_rows and result.files_after <= result.files_before and result.row_count == 40
    assert sorted(n for n in os.listdir(target) if "=" in n) == sorted(n for n in before if "=" in n)
    assert rows(spark.read.schema("id long, p string, q string").parquet(target)) == rows(table)


@pytest.mark.parametrize("descending", [False, True])
def test_deep_pages_with_any_tie_break(spark, descending):
    chance = random.Random(1)
    data = [(chance.choice([None, 1.5, 2.5, 3.5]), f"k{i:04d}") for i in range(900)]
    table = spark.createDataFrame(data, "v double, k string").repartition(7)
    order = sorted(data, key=lambda r: r[1])
    order = sorted(order, key=lambda r: (r[0] is not None, r[0] or 0), reverse=descending)
    for offset in (0, 333, 700, 890, 2000):
        got = page(table, "v", descending, limit=20, offset=offset, tie_break="k", top_k_rows=40, numbered=True).collect()
        assert [(r.v, r.k) for r in got] == order[offset:offset + 20]
        assert [r.row_number for r in got] == list(range(offset + 1, offset + 1 + len(got)))


def test_unsorted_deep_pages_cover_the_table(spark):
    table = spark.range(0, 1000, 1, 9)
    seen = [r.id for at in range(0, 1000, 100) for r in page(table, limit=100, offset=at, top_k_rows=50).collect()]
    assert sorted(seen) == list(range(1000))


def test_value_filter_takes_plain_numbers_only(spark):
    table = spark.createDataFrame([(99, 1.5, None), (7, float("nan"), None)], "i int, d double, n decimal(30,2)")
    big = "1" + "0" * 25
    assert value_filter(table, {"i": [big, "9_9", "nan", "inf", " 99 "]}).count() == 1
    assert value_filter(table, {"i": ["9_9", "nan", "7.5", "99999999999"]}).count() == 0
    assert value_filter(table, {"d": ["nan", "inf"]}).count() == 0 and value_filter(table, {"d": ["1.5e0"]}).count() == 1
    assert value_filter(table, {"n": [big]}).count() == 0


# -- SQL text ----------------------------------------------------------------------------------------

def test_sql_text_leaves_strings_names_and_comments_alone():
    assert spark_text("SELECT 'a LIKE b', \"GLOB\", `TOTAL(x)` -- LIKE\n FROM t /* GLOB */") == (
        "SELECT 'a LIKE b', `GLOB`, `TOTAL(x)` -- LIKE\n FROM t /* GLOB */")
    assert spark_text("a like 'x'") == "a ILIKE 'x'"
    assert spark_text("total(a + f(b, c))") == "coalesce(sum(CAST(a + f(b, c) AS DOUBLE)), 0D)"
    with pytest.raises(ValueError):
        spark_text("a GLOB b")


def test_statements():
    assert statements("a; 'x;y' ;; -- c;\n b /* ; */;") == ["a", "'x;y'", "-- c;\n b /* ; */"]
    assert statements(" ; -- only\n") == []


def test_unknown_date_codes_are_errors_in_sql(spark, folder):
    workspace = Workspace(spark, folder.new("ws"))
    with pytest.raises(Exception, match="Unknown date code"):
        workspace.sql("SELECT strftime('%Q', TIMESTAMP_NTZ'2024-01-01 00:00:00')").collect()
    assert workspace.sql("SELECT strftime('%J', TIMESTAMP_NTZ'2024-01-01 12:00:00') AS j").first().j == "2460311.0"


def test_workspaces_do_not_mix(spark, folder):
    one, two = Workspace(spark, folder.new("one")), Workspace(spark, folder.new("two"))
    one.sql("CREATE TABLE t AS SELECT 1 AS a")
    two.sql("CREATE TABLE t AS SELECT 2 AS a")
    assert (one.sql("SELECT a FROM t").first().a, two.sql("SELECT a FROM t").first().a) == (1, 2)
    result = one.script("SELECT a FROM t; INSERT INTO t SELECT 5; DROP TABLE t")
    assert [r.a for r in result.collect()] == [1]
