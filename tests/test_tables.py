import calendar
import glob
import io
import os
import zipfile

import pytest

from conftest import rows
from pyspark.sql import functions as F

from gridloom.cluster import publish
from gridloom.functions import sqlite
from gridloom.functions.text import cell_text, decode_bytes, encode_bytes
from gridloom.operators.ingest import ingest, ingest_by_layout, typed_rows
from gridloom.plans.workspace import Workspace, prepare_session
from gridloom.sinks.export import export_cells, export_csv
from gridloom.sinks.materialize import compact, fingerprint, materialize
from gridloom.sources.archive import archive_lines, archive_records, read_archives
from gridloom.sources.delimited import Dialect, parse_records
from gridloom.streaming.watch import watch_any, watch_folder, watched, watched_layouts


def written(target):
    return [open(p, "rb").read() for p in sorted(glob.glob(os.path.join(target, "part-*.csv")))]


# Export

def test_escaping_and_byte_order_mark(spark, folder):
    df = spark.createDataFrame([("2", "Kowalski, Jan"), ("3", 'a "b"'), ("4", "x\ny"), ("5", "p\rq"), (None, " z ")],
                               "Id string, Name string").coalesce(1)
    target = export_csv(df, folder.new("out"))
    assert written(target) == [
        '﻿Id,Name\n2,"Kowalski, Jan"\n3,"a ""b"""\n4,"x\ny"\n5,"p\rq"\n, z \n'.encode()]
    assert os.path.exists(os.path.join(target, "_SUCCESS"))


def test_formula_guard(spark, folder):
    df = spark.createDataFrame([("=2+2",), ("@SUM(A1:A2)",), ("-5",), ("+1",), ("2-1",), ("",)], "Value string").coalesce(1)
    assert written(export_csv(df, folder.new("a"), byte_order_mark=False))[0].decode().split("\n") == [
        "Value", "'=2+2", "'@SUM(A1:A2)", "'-5", "'+1", "2-1", '""', ""]
    assert written(export_csv(df, folder.new("b"), header=False, protect_formulas=False))[0].startswith(b"=2+2\n")


def test_subset_filters_and_checks(spark, folder):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "Id int, Name string").coalesce(1)
    target = export_csv(df, folder.new("s"), ";", columns=["name"], filters={"Id": ["2"]}, byte_order_mark=False)
    assert b"".join(written(target)) == b"Name\nb\n"
    with pytest.raises(ValueError):
        export_csv(df, folder.new("x"), columns=["Nope"])
    with pytest.raises(ValueError):
        export_csv(df, " ")


def test_failed_export_keeps_the_old_one(spark, folder):
    target = export_csv(spark.createDataFrame([(1,)], "a int").coalesce(1), folder.new("t"))
    bad = spark.createDataFrame([(0,)], "a int").select((F.lit(1) / F.col("a")).alias("a"))
    with pytest.raises(Exception):
        export_csv(bad, target)
    assert written(target) == [b"\xef\xbb\xbfa\n1\n"]
    export_csv(spark.createDataFrame([(2,)], "a int").coalesce(1), target)
    assert written(target) == [b"\xef\xbb\xbfa\n2\n"]
    with pytest.raises(OSError):
        publish(spark, folder.new("missing"), target)
    assert written(target) == [b"\xef\xbb\xbfa\n2\n"]


def test_cell_text(spark):
    numbers = [5.0, 12.5, 12345678.0, 123456789.25, 1e15, 1.5e20, 0.0005, 1e-5, 2.5e-7, -3.25e9, 0.1]
    df = spark.createDataFrame([(n,) for n in numbers], "d double")
    texts = [r.t for r in df.select(cell_text(F.col("d"), df.schema["d"].dataType).alias("t")).collect()]
    assert texts == ["5", "12.5", "12345678", "123456789.25", "1E+15", "1.5E+20", "0.0005", "0.00001", "2.5E-07",
                     "-3250000000", "0.1"]
    other = spark.sql("SELECT true b, timestamp'2024-01-05 01:02:03.4' ts, timestamp_ntz'2024-01-05 01:02:03' n, 7 i")
    assert rows(export_cells(other)) == [("1", "2024-01-05T01:02:03.4000000+00:00", "2024-01-05T01:02:03.0000000", "7")]


def test_single_byte_encodings(spark):
    df = spark.createDataFrame([("Zażółć gęślą jaźń €",)], "t string")
    for name in ("windows-1250", "cp1252", "iso-8859-15", "cp1250"):
        text = "Zażółć gęślą jaźń €" if "1250" in name else "café €"
        raw = spark.createDataFrame([(text,)], "t string").select(encode_bytes(F.col("t"), name).alias("t"))
        assert bytes(raw.select(F.col("t").cast("binary")).first()[0]) == text.encode(name)
        assert raw.select(decode_bytes(F.col("t"), name)).first()[0] == text
    with pytest.raises(ValueError):
        df.select(decode_bytes(F.col("t"), "utf-16"))


# Tables

def test_materialize(spark, folder):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "Id int, Name string")
    assert materialize(df, "kept_rows", folder.new("kept"), ["Id"], {"Name": ["a"]}) == 2
    assert rows(spark.table("kept_rows")) == [(1,), (3,)]
    with pytest.raises(ValueError):
        materialize(df, "kept_rows_2", folder.new("kept"))
    with pytest.raises(ValueError):
        materialize(df, "kept_rows_3", folder.new("kept3"), ["Nope"])
    spark.sql("DROP TABLE kept_rows")


def test_compact(spark, folder):
    path = folder.new("many")
    spark.range(1000).selectExpr("id", "if(id % 3 = 0, null, id % 7) AS k").repartition(20).write.parquet(path)
    before = fingerprint(spark.read.parquet(path)).first()
    result = compact(spark, path).first()
    assert (result.row_count, result.same_rows, result.files_before, result.files_after) == (1000, True, 20, 1)
    assert fingerprint(spark.read.parquet(path)).first() == before


# SQL

def test_workspace(spark, folder):
    workspace = Workspace(spark, folder.new("ws"))
    workspace.save("people", spark.createDataFrame([(1, "Ada"), (2, "Ola")], "Id int, Name string"))
    again = Workspace(spark, folder.new("ws"))
    assert rows(again.sql("SELECT Name FROM people WHERE id > 1")) == [("Ola",)]
    last = again.script([
        f"CREATE TABLE made USING parquet LOCATION '{folder.new('made')}' AS SELECT Id FROM people",
        "SELECT 1 AS one", "INSERT INTO made VALUES (9)", "SELECT sum(Id) AS s FROM made", "DROP TABLE made"])
    assert rows(last) == [(12,)]
    assert again.script(["CREATE OR REPLACE TEMPORARY VIEW v AS SELECT 1 AS a"]).columns == ["status"]
    assert again.sql("SELECT * FROM range(12000)").count() == 12000


def test_sqlite_functions(spark, folder):
    Workspace(spark, folder.new("none"))
    df = spark.sql("""SELECT julianday(ts) j, datetime(ts) d, timetext(ts) t, strftime('%Y/%m at %H:%M:%S %% %j', ts) f
                      FROM VALUES (timestamp'2024-01-01 12:00:05') t(ts)""")
    assert rows(df) == [(pytest.approx(2460311.0000578705), "2024-01-01 12:00:05", "12:00:05", "2024/01 at 12:00:05 % 001")]
    base = spark.sql("SELECT timestamp'2024-01-01 12:00:05' ts")
    ts = F.col("ts")
    assert rows(base.select(sqlite.strftime("%Y/%m at %H:%M %% %w", ts), sqlite.date_text(ts), sqlite.time_text(ts))) == [
        ("2024/01 at 12:00 % 1", "2024-01-01", "12:00:05")]
    empty = spark.createDataFrame([], "x int")
    assert rows(empty.agg(sqlite.total(F.col("x")), sqlite.group_concat("x"))) == [(0.0, None)]
    some = spark.createDataFrame([("b", 1), (None, 2), ("a", 3)], "x string, n int")
    assert rows(some.agg(sqlite.group_concat("x").alias("a"), sqlite.group_concat("x", "'", "n").alias("b"))) == [
        ("a,b", "b'a")]
    assert 0 <= spark.sql("SELECT random() r").first().r < 1


@pytest.mark.parametrize("pattern,text,hit", [
    ("a*", "abc", True), ("a*", "ABC", False), ("a?c", "abc", True), ("a?c", "ac", False), ("[a-c]x", "bx", True),
    ("[^a-c]x", "bx", False), ("a.c", "abc", False), ("a.c", "a.c", True), ("*", "x\ny", True), ("a", "a\n", False),
    ("[]]", "]", True), ("[*]", "*", True), ("a[", "a[", True),
])
def test_glob(spark, pattern, text, hit):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(sqlite.glob(F.col("t"), pattern)).first()[0] is hit


# ZIP

def test_zip_entries(spark, folder):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        archive.writestr("harvest/rye.Csv", "Field|Tons\nhill|4\nmarsh|0")
        archive.writestr("oats.csv", "\ufeffField|Tons\r\nbank|11\r\n")
        archive.writestr("harvest/map.png", b"\x89PNG")
    folder("in/a.ZIP", packed.getvalue())
    lines = archive_lines(read_archives(spark, folder.new("in")))
    assert {(r.entry, r.line_number, bytes(r.line)) for r in lines.collect()} == {
        ("oats.csv", 1, b"Field|Tons\r"), ("oats.csv", 2, b"bank|11\r"), ("harvest/rye.Csv", 1, b"Field|Tons"),
        ("harvest/rye.Csv", 2, b"hill|4"), ("harvest/rye.Csv", 3, b"marsh|0")}
    dialect = Dialect.named("Field", "Tons", delimiter="|")
    from gridloom.operators.ingest import Staged
    staged = Staged(typed_rows(parse_records(archive_records(lines), dialect), dialect))
    assert rows(staged.accepted()) == [("bank", "11"), ("hill", "4"), ("marsh", "0")]


def test_zip_without_csv_is_an_error(spark, folder):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        archive.writestr("notes.txt", "no")
    folder("none.zip", packed.getvalue())
    with pytest.raises(Exception, match="holds no CSV file"):
        archive_lines(read_archives(spark, folder.new("none.zip"))).collect()


# Watched folder

def test_watched_folder(spark, folder):
    dialect = Dialect(("Id", "Name"), ";", header_line="Id;Name")
    where = dict(folder=folder.new("in"), table=folder.new("table"), checkpoint=folder.new("check"), dialect=dialect, once=True)
    folder("in/a.csv", "Id;Name\n1;Ada\nbroken\n")
    folder("in/b.CSV", "Id;Name\n2;Ola\n")
    folder("in/skip.txt", "Id;Name\n9;No\n")
    folder("in/deep/c.csv", "Id;Name\n8;Deep\n")
    watch_folder(spark, **where).awaitTermination()
    assert rows(watched(spark, where["table"]).accepted()) == [("1", "Ada"), ("2", "Ola")]
    folder("in/d.csv", "Id;Name\n3;Zen\nId;Name\n;;;\n")
    watch_folder(spark, **where).awaitTermination()
    watch_folder(spark, **where).awaitTermination()
    staged = watched(spark, where["table"])
    assert rows(staged.accepted()) == [("1", "Ada"), ("2", "Ola"), ("3", "Zen"), ("Id", "Name")]
    assert {(r.source_file.rsplit("/", 1)[1], r.row_number, r.raw_row) for r in staged.rejected().collect()} == {
        ("a.csv", 3, "broken"), ("d.csv", 4, ";;;")}
    assert {(r.source_file.rsplit("/", 1)[1], r.row_count, r.rejected_count) for r in staged.manifest().collect()} == {
        ("a.csv", 1, 1), ("b.CSV", 1, 0), ("d.csv", 2, 1)}


def test_round_trip_of_awkward_cells(spark, folder):
    cells = [("a;b", 'say "hi"'), ("=1", " pad "), ("", "x\ny"), ("'", "\t"), ('"', '""'), ("ż", "p\r\nq")]
    df = spark.createDataFrame(cells, "A string, B string")
    target = export_csv(df, folder.new("out"), ";", protect_formulas=False)
    dialect = Dialect(("A", "B"), ";", header_line="A;B", quoted_newlines=True)
    assert rows(ingest(spark, target, folder.new("back"), dialect, trim=False).accepted()) == sorted(cells)


def test_watched_folder_of_mixed_layouts(spark, folder):
    where = dict(folder=folder.new("in"), tables=folder.new("tables"), checkpoint=folder.new("check"), once=True)
    folder("in/dane [1] ąę 100%.csv", "Kod;Opis\n1;Żaba\nx\n", "cp1250")
    folder("in/b.csv", "Id,Name\n2,Ola\n")
    folder("in/c.csv", "Kod\tOpis\n3\tKot\n")
    folder("in/empty.csv", "")
    watch_any(spark, **where).awaitTermination()
    folder("in/d.csv", "Id,Name\n4,Ada\n")
    watch_any(spark, **where).awaitTermination()
    watch_any(spark, **where).awaitTermination()
    layouts = watched_layouts(spark, where["tables"])
    assert [r.source_file.rsplit("/", 1)[-1] for r in layouts.pop("problems").rejected().collect()] == ["empty.csv"]
    found = {tuple(s.columns): s for s in layouts.values()}
    assert set(found) == {("Kod", "Opis"), ("Id", "Name")}
    assert rows(found["Kod", "Opis"].accepted()) == [("1", "Żaba"), ("3", "Kot")]
    assert [r.message for r in found["Kod", "Opis"].rejected().collect()] == ["Expected 2 fields, found 1."]
    assert rows(found["Id", "Name"].accepted()) == [("2", "Ola"), ("4", "Ada")]
    assert sorted(r.row_count for r in found["Id", "Name"].manifest().collect()) == [1, 1]


def test_ingest_by_layout(spark, folder):
    folder("in/a.csv", "Id;Name\n1;Ada\n")
    folder("in/deep/b.csv", "Id,Name\n2,Ola\n")
    folder("in/c.csv", "Town;Id\nKielce;3\n")
    found = {tuple(s.columns): rows(s.accepted()) for s in ingest_by_layout(spark, folder.new("in"), folder.new("o")).values()}
    assert found == {("Id", "Name"): [("1", "Ada"), ("2", "Ola")], ("Town", "Id"): [("Kielce", "3")]}


def test_clock_functions_do_not_depend_on_the_zone(spark, folder):
    previous = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # Spark keeps the zone in which a SQL function was made.
        prepare_session(spark)
        base = spark.sql("SELECT timestamp_ntz'2024-11-03 01:30:00.25' n, timestamp'2024-07-03 01:30:00.25' t")
        for name, moment in (("n", (2024, 11, 3, 1, 30, 0)), ("t", (2024, 7, 3, 1, 30, 0))):
            day = (calendar.timegm(moment) * 1000 + 250 + 210866760000000) / 86400000
            row = base.select(sqlite.julian_day(F.col(name)), F.expr(f"julianday({name})"),
                              sqlite.strftime("%s", F.col(name)), F.expr(f"strftime('%s', {name})")).first()
            assert row[0] == row[1] == day
            assert row[2] == row[3]
    finally:
        spark.conf.set("spark.sql.session.timeZone", previous)
        prepare_session(spark)
