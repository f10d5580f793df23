import datetime as dt

import pytest

from conftest import rows
from gridloom.operators.ingest import ColumnMapping, ingest, preview, promote, resolve_mappings
from gridloom.sources.delimited import Dialect
from gridloom.sources import dialect as dialect_module
from gridloom.sources.dialect import detect, layouts, looks_like_value, profile
from gridloom.sources.naming import column_names, identifier


def staged(spark, folder, path, **options):
    return ingest(spark, path, folder.new("staged"), **options)


def test_bridges_keep_names_and_text(spark, folder):
    result = staged(spark, folder, folder("bridges.csv", "River;Spans;Built\r\nWeser;3;1911\r\nNaab;1;0870\r\nIsar;12;\r\n"))
    assert result.columns == ["River", "Spans", "Built"]
    assert rows(result.accepted()) == [("Isar", "12", ""), ("Naab", "1", "0870"), ("Weser", "3", "1911")]
    assert result.rejected().count() == 0


def test_ragged_rows_go_to_quarantine(spark, folder):
    text = "Kiln,Batch,Grams\nnorth,7,310\nsouth,8\nwest\neast,9,120,wet,late\nnorth,10,95\n"
    result = staged(spark, folder, folder("kilns.csv", text))
    assert rows(result.accepted()) == [("north", "10", "95"), ("north", "7", "310")]
    bad = result.rejected().orderBy("row_number").collect()
    assert [(r.row_number, r.message, r.raw_row) for r in bad] == [
        (3, "Expected 3 fields, found 2.", "south,8"),
        (4, "Expected 3 fields, found 1.", "west"),
        (5, "Expected 3 fields, found 5.", "east,9,120,wet,late"),
    ]


def test_field_count_ignores_quoted_delimiters(spark, folder):
    text = 'a;b;c\n"x;y";"he said ""hi;""";\n"x;y";"";\n;;\n1;"2;3"\n"";"";"";"p;q"\n'
    result = staged(spark, folder, folder("q.csv", text), dialect=Dialect(("a", "b", "c"), ";", header_line="a;b;c"))
    assert rows(result.accepted()) == [("", "", ""), ("x;y", "", ""), ("x;y", 'he said "hi;"', "")]
    assert sorted(r.message for r in result.rejected().collect()) == [
        "Expected 3 fields, found 2.", "Expected 3 fields, found 4."]


def test_windows_1250_is_decoded_without_being_told(spark, folder):
    path = folder("plants.csv", "Roślina\tNáklad\tŠířka\nDąb\t12\tčtyři\nJeřáb\t9\tőrült\n", "cp1250")
    assert detect(spark, path).encoding == "windows-1250"
    assert rows(staged(spark, folder, path).accepted()) == [("Dąb", "12", "čtyři"), ("Jeřáb", "9", "őrült")]


def test_byte_order_mark_is_dropped(spark, folder):
    result = staged(spark, folder, folder("b.csv", "﻿Id;Name\n1;Ada\n"))
    assert result.columns == ["Id", "Name"]
    assert rows(result.accepted()) == [("1", "Ada")]


def test_header_only_gives_columns_and_no_rows(spark, folder):
    result = staged(spark, folder, folder("h.csv", "Name,City\r\n"))
    assert result.columns == ["Name", "City"]
    assert result.accepted().count() == 0
    assert [(r.row_count, r.rejected_count) for r in result.manifest().collect()] == [(0, 0)]


def test_empty_file_is_an_error(spark, folder):
    with pytest.raises(ValueError, match="holds a record"):
        staged(spark, folder, folder("e.csv", ""))


def test_preamble_and_trailing_empty_column(spark, folder):
    text = "Meters: first page of two\r\nMeter;\r\n700411900028816354;\r\n700411900031125908;\r\n"
    result = staged(spark, folder, folder("p.csv", text))
    assert result.columns == ["Meter"]
    assert rows(result.accepted()) == [("700411900028816354",), ("700411900031125908",)]
    assert result.rejected().count() == 0


def test_trailing_columns_are_cut_only_where_blank(spark, folder):
    text = "Id;Name;;\n1;Ada;;\n2;Ola; ;\n3;Zen;x;\n4;Eva\n5;\n6;Iga;;;\n"
    result = staged(spark, folder, folder("t.csv", text))
    assert result.columns == ["Id", "Name"]
    assert rows(result.accepted()) == [("1", "Ada"), ("2", "Ola"), ("4", "Eva"), ("5", "")]
    assert {(r.row_number, r.message) for r in result.rejected().collect()} == {
        (4, "Expected 2 fields, found 4."), (7, "Expected 2 fields, found 3.")}


def test_typed_columns_and_quarantine(spark, folder):
    text = ("Station|Depth|Sounded|Open|Remark\nFjord 1|1 250,75|2021-05-06|true|calm\nFjord 2|-3|x|0|\nFjord 3||||\n"
            "Fjord 4|deep|2021-05-07|1|?\nFjord 5|0,5|2020-02-29|0|ice\n").replace("|", "\t")
    mappings = [
        ColumnMapping(3, "In_Use", "Boolean"), ColumnMapping(1, "Metres", "Decimal"), ColumnMapping(4, "Notes", include=False),
        ColumnMapping(0, "Place"), ColumnMapping(2, "Day", "Date")]
    result = staged(spark, folder, folder("depths.tsv", text), mappings=mappings)
    assert result.accepted().dtypes == [("In_Use", "boolean"), ("Metres", "double"), ("Place", "string"), ("Day", "timestamp")]
    assert rows(result.accepted()) == [
        (None, None, "Fjord 3", None), (False, 0.5, "Fjord 5", dt.datetime(2020, 2, 29)), (True, 1250.75, "Fjord 1", dt.datetime(2021, 5, 6))]
    assert sorted(tuple(r)[1:3] for r in result.rejected().collect()) == [
        (3, "Value 'x' cannot be converted to Date."), (5, "Value 'deep' cannot be converted to Decimal.")]
    assert result.accepted().schema["Place"].metadata["original_name"] == "Station"


@pytest.mark.parametrize("text,value", [
    ("12,50", 12.5), ("1,234.5", 1234.5), ("1 234,5", 1234.5), ("1 234,5", 1234.5), (",5", 0.5),
    ("5-", -5.0), ("+7", 7.0), ("-3,25", -3.25), ("1,2,3.5", 123.5), (" 4 ", 4.0),
    ("NaN", "bad"), ("1e3", "bad"), ("1 234.5", "bad"), ("1,2,3", "bad"), ("--1", "bad"), (".", "bad"),
    ("1" * 30, "bad"), ("", None), ("  ", None),
])
def test_decimals(spark, text, value):
    from pyspark.sql import functions as F
    from gridloom.functions.convert import conversion_error, convert
    df = spark.createDataFrame([(text,)], "t string").withColumn("v", convert(F.col("t"), "Decimal"))
    row = df.withColumn("e", conversion_error(F.col("t"), F.col("v"), "Decimal")).first()
    if value == "bad":
        assert row.v is None and row.e == f"Value '{text}' cannot be converted to Decimal."
    else:
        assert row.v == value and row.e is None


def test_other_types(spark):
    from pyspark.sql import functions as F
    from gridloom.functions.convert import convert
    cells = [" 42 ", "+7", "1.5", "5L", "9223372036854775808", "TRUE", "tAk", "TAK", "0", "2024-02-30",
             "2024-02-29", "2024-02-29T10:11:12.5", "5.3.2024", "05.03.2024 7:08", "2024", "abc", ""]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, t string")
    got = df.select("i", *[convert(F.col("t"), k).alias(k) for k in ("Integer", "Boolean", "Date")]).orderBy("i").collect()
    by = {cells[r.i]: r for r in got}
    assert [by[c].Integer for c in (" 42 ", "+7", "1.5", "5L", "9223372036854775808", "")] == [42, 7, None, None, None, None]
    assert [by[c].Boolean for c in ("TRUE", "tAk", "TAK", "0", "abc")] == [True, None, True, False, None]
    assert by["2024-02-29"].Date == dt.datetime(2024, 2, 29)
    assert by["2024-02-29T10:11:12.5"].Date == dt.datetime(2024, 2, 29, 10, 11, 12, 500000)
    assert by["5.3.2024"].Date == dt.datetime(2024, 3, 5)
    assert by["05.03.2024 7:08"].Date == dt.datetime(2024, 3, 5, 7, 8)
    assert [by[c].Date for c in ("2024-02-30", "2024", "abc", "")] == [None] * 4


def test_trim_can_be_turned_off(spark, folder):
    path = folder("pads.csv", "Hull,Mast\n\u2003oak \t,pine\n ash,\u00a0 \n")
    dialect = Dialect.named("Hull", "Mast", delimiter=",")
    assert rows(ingest(spark, path, folder.new("a"), dialect).accepted()) == [("ash", ""), ("oak", "pine")]
    assert rows(ingest(spark, path, folder.new("b"), dialect, trim=False).accepted()) == [(" ash", "\u00a0 "), ("\u2003oak \t", "pine")]


def test_no_header_is_detected(spark, folder):
    result = staged(spark, folder, folder("tides.csv", "high,Bremen,west\nlow,Husum,north\nhigh,Emden,west\n"))
    assert result.columns == ["Column1", "Column2", "Column3"]
    assert rows(result.accepted()) == [("high", "Bremen", "west"), ("high", "Emden", "west"), ("low", "Husum", "north")]


def test_repeated_headers_get_distinct_names(spark, folder):
    result = staged(spark, folder, folder("d.csv", "Net kg,net-kg,7th,Net kg\n1,2,3,4\n"),
                    dialect=Dialect.named("Net kg", "net-kg", "7th", "Net kg", delimiter=","))
    assert result.columns == ["Net_kg", "net_kg_2", "Column_7th", "Net_kg_3"]


def test_names():
    assert len(set(column_names(["A", "A", "A_2"]))) == 3
    assert column_names(["", " ", "a", "A", "?"]) == ["Column1", "Column2", "a", "A_2", "Column"]
    assert identifier("x" * 80) == "x" * 56
    assert identifier("Żółw (kg)") == "Żółw__kg"


def test_header_row_repeated_in_the_data_is_kept(spark, folder):
    result = staged(spark, folder, folder("rep.csv", "Id;Name\n1;Ada\nId;Name\n"))
    assert rows(result.accepted()) == [("1", "Ada"), ("Id", "Name")]


def test_several_files_lose_one_header_each(spark, folder):
    for i in range(5):
        folder(f"in/f{i}.csv", f"Id;Name\n{i};n{i}\n{i};\n")
    result = ingest(spark, folder.new("in"), folder.new("out"))
    assert result.accepted().count() == 10
    assert sorted((r.row_count, r.rejected_count) for r in result.manifest().collect()) == [(2, 0)] * 5


def test_blank_cells_in_a_tab_file_are_a_row(spark, folder):
    result = staged(spark, folder, folder("tab.csv", "Id\tName\n1\tAda\n\t\n\n2\tOla\n"))
    assert rows(result.accepted()) == [("", ""), ("1", "Ada"), ("2", "Ola")]


def test_quoted_newlines_across_splits(spark, folder):
    wanted, lines = [], ['Id;Text']
    for i in range(400):
        text = f"line one {i}\nline; two\r\n\n\"quoted\" {'x' * (i % 50)}." if i % 3 else f"plain {i}"
        wanted.append((str(i), text))
        lines.append(f'{i};"' + text.replace('"', '""') + '"' if i % 3 else f"{i};{text}")
    path = folder("multi.csv", "\r\n".join(lines) + "\r\n")
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        dialect = detect(spark, path)
        assert dialect.quoted_newlines
        result = ingest(spark, path, folder.new("out"), dialect)
        assert rows(result.accepted()) == sorted(wanted)
        assert result.rejected().count() == 0
        whole = result.rows.select("_row_id")
        assert whole.distinct().count() == whole.count() == 401
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)


def test_row_numbers_hold_across_splits(spark, folder):
    lines = ["Id;Name"] + [f"{i};n" if i % 10 else f"{i}" for i in range(1, 301)]
    path = folder("big.csv", "\n".join(lines))
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        bad = staged(spark, folder, path).rejected().collect()
        assert sorted((r.row_number, r.raw_row) for r in bad) == [(i + 1, str(i)) for i in range(10, 301, 10)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)


def test_profile_and_layouts(spark, folder):
    folder("in/a.csv", "Id;Name\n1;Ada\n")
    folder("in/b.csv", "Id;Name\n2;Ola\n3;Zen\n")
    folder("in/c.csv", "x,y\nu,w\n")
    folder("in/d.csv", "Kod\tOpis\n1\tŻaba\n", "cp1250")
    found = {r.source_file.rsplit("/", 1)[1]: r for r in profile(spark, folder.new("in")).collect()}
    assert (found["a.csv"].delimiter, found["a.csv"].encoding, found["a.csv"].has_header) == (";", "utf-8", True)
    assert (found["c.csv"].delimiter, found["c.csv"].has_header, found["c.csv"].column_names) == (",", False, ["Column1", "Column2"])
    assert (found["d.csv"].delimiter, found["d.csv"].encoding, found["d.csv"].column_names) == ("\t", "windows-1250", ["Kod", "Opis"])
    assert layouts(profile(spark, folder.new("in"))).count() == 3
    with pytest.raises(ValueError, match="differ"):
        detect(spark, folder.new("in"))


def test_values():
    for text in ("1", "-1,234.50", "1e5", "(3)", "2024-01-05", "1/5/2024", "10:30", "2024-01-05T10:00:00Z", "True", "a@b"):
        assert looks_like_value(text), text
    for text in ("", "Ada", "12 Main St", "x1", "1-2-x"):
        assert not looks_like_value(text), text


def test_preview_shows_ragged_rows(spark, folder):
    path = folder("pv.csv", "Name;Age\n" + "".join(f"n{i};{i}\n" for i in range(50)) + "short\n" + "z;1\n" * 100)
    shown = preview(spark, path).collect()
    assert len(shown) == 100
    assert shown[0][:2] == ("n0", "0") and shown[0].ragged_row is None
    assert shown[50].ragged_row == "short" and shown[50].Name == "short"


def test_stage_then_promote(spark, folder):
    result = staged(spark, folder, folder("s.csv", "Id;Name;City\n1;Ada;Kielce\n"))
    chosen = promote(result, [ColumnMapping(2, "Town"), ColumnMapping(0, "Key")])
    assert chosen.columns == ["Town", "Key"] and rows(chosen) == [("Kielce", "1")]
    with pytest.raises(ValueError):
        promote(result, [ColumnMapping(0, "Key", "Integer")])


def test_mapping_errors():
    for mappings in ([], [ColumnMapping(0, "a", include=False)], [ColumnMapping(2, "a")], [ColumnMapping(0, " ")],
                     [ColumnMapping(0, "a", "Money")]):
        with pytest.raises(ValueError):
            resolve_mappings(mappings, ["x", "y"])


def test_named_encoding_and_delimiter_win(spark, folder):
    path = folder("iso.csv", "Nazwa|Opis\nżółć|x;y;z\n", "iso-8859-2")
    dialect = detect(spark, path, encoding="iso-8859-2", delimiter="|")
    assert dialect.header == ("Nazwa", "Opis")
    assert rows(ingest(spark, path, folder.new("o"), dialect).accepted()) == [("żółć", "x;y;z")]


def test_preview_of_records_that_span_lines(spark, folder):
    path = folder("sp.csv", "Id;Text\n" + "".join(f'{i};"a\nb\nc\n{i}"\n' for i in range(500)))
    shown = preview(spark, path, rows=30).collect()
    assert [(r.Id, r.Text) for r in shown] == [(str(i), f"a\nb\nc\n{i}") for i in range(30)]


def test_profile_without_a_pass_over_the_text(spark, folder, monkeypatch):
    path = folder("cheap.csv", "Id;Name\n1;Ada\n")

    def text_pass(raw):
        raise AssertionError("a pass over all text")

    # the heads are two scans, of large and of small files, and nothing else reads the text
    heads = dialect_module._head_lines(spark, path, None, 64)
    assert heads._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    monkeypatch.setattr(dialect_module, "_text_checks", text_pass)
    cheap = profile(spark, path, encoding="utf-8", quoted_newlines=False)
    assert cheap.first().column_names == ["Id", "Name"]
    with pytest.raises(AssertionError):
        profile(spark, path)


@pytest.mark.parametrize("delimiter", [";", "\t", " "])
def test_every_kind_of_padding_is_trimmed(spark, folder, delimiter):
    from gridloom.functions.text import WHITESPACE
    name = "\u0142x" if delimiter != ";" else "x"
    lines, wanted = [], []
    for number, space in enumerate(ch for ch in WHITESPACE if ch not in "\n\r" + delimiter):
        for cell in (f"{name}{space}", f"{space}{name}", f'"{space}{name}{space}"', f"{space}{space}"):
            for position in range(3):
                cells = ["a", "b", str(number)]
                cells[position] = cell
                lines.append(delimiter.join(cells))
                cells[position] = name if name in cell else ""
                wanted.append(tuple(cells))
    path = folder("pad.csv", "\n".join(lines))
    dialect = Dialect(("A", "B", "C"), delimiter, has_header=False)
    assert rows(ingest(spark, path, folder.new("out"), dialect).accepted()) == sorted(wanted)


def test_profile_of_files_larger_than_a_split(spark, folder):
    body = "".join(f"{i};człowiek {i};{i * 1.5}\n" for i in range(2000))
    folder("in/large.csv", "Nr;Nazwa;Kwota\n" + body, "cp1250")
    folder("in/other.csv", "Kod,Opis\n" + "1,x\n" * 900)
    folder("in/small.csv", "Kod,Opis\n1,x\n")
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found = {r.source_file.rsplit("/", 1)[1]: r for r in profile(spark, folder.new("in")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)
    assert {n: (r.delimiter, r.encoding, r.column_names) for n, r in found.items()} == {
        "large.csv": (";", "windows-1250", ["Nr", "Nazwa", "Kwota"]),
        "other.csv": (",", "utf-8", ["Kod", "Opis"]), "small.csv": (",", "utf-8", ["Kod", "Opis"])}


def test_one_late_byte_changes_the_encoding_of_the_file(spark, folder):
    path = folder("late.csv", b"Id;Name\n" + b"1;Ada\n" * 5000 + "2;Żółw\n".encode("cp1250"))
    result = staged(spark, folder, path)
    assert result.accepted().where("Id = 2").first().Name == "Żółw"
    assert result.accepted().count() == 5001


def test_one_late_line_break_is_seen(spark, folder):
    path = folder("late.csv", "Id;Name\n" + "1;Ada\n" * 5000 + '2;"a\nb"\n')
    assert staged(spark, folder, path).accepted().where("Id = 2").first().Name == "a\nb"


def test_casts_of_the_caller_never_meet_header_or_rejected_rows(spark, folder):
    text = "Id;Name\n" + "".join(f"{i};n\n" for i in range(20)) + "bad\nworse;x;y\n"
    accepted = staged(spark, folder, folder("c.csv", text)).accepted()
    assert accepted.where("CAST(Id AS INT) > 17").count() == 2
    assert accepted.selectExpr("CAST(Id AS INT) AS n").where("n >= 0").agg({"n": "sum"}).first()[0] == 190
    repeated = ingest(spark, folder("d.csv", text.split("bad")[0] + "Id;Name\n"), folder.new("again")).accepted()
    assert repeated.where("try_cast(Id AS INT) IS NULL").count() == 1


def test_first_leads_by_split_then_row_without_sorting(spark):
    from gridloom.operators.ingest import first_leads

    staged = spark.createDataFrame(
        [("a", 40, 1, 0), ("a", 0, 9, 1), ("a", 0, 7, 2), ("b", 10, 3, 0), ("b", 10, 2, 1), ("b", 70, 0, 0)],
        "_source_file string, _block_start long, _row_id long, _lead tinyint")
    found = first_leads(staged)
    assert sorted((r._source_file, r._first, r._doubtful) for r in found.collect()) == [("a", 2, 2), ("b", 1, 1)]
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_typed_quarantine_stages_without_sorting_its_rows(spark, folder):
    from gridloom.operators.ingest import first_leads

    head = "order;line;price;open;shipped\n"
    folder("lines/part-0.csv", head + "1;1;10,5;tak;02.01.1996\n97;first;3,25;nie;03.01.1996\n")
    path = folder("lines/part-1.csv", head + "97;2;n/a;;04.01.1996\n98;1;7,00;tak;05.01.1996\n")
    mappings = [ColumnMapping(0, "order_id", "Integer"), ColumnMapping(1, "line_id", "Integer"),
                ColumnMapping(2, "price", "Decimal"), ColumnMapping(3, "is_open", "Boolean"), ColumnMapping(4, "shipped", "Date")]
    result = staged(spark, folder, path.rsplit("/", 1)[0], mappings=mappings)
    assert rows(result.rejected().select("message", "raw_row")) == [
        ("Value 'first' cannot be converted to Integer.", "97;first;3,25;nie;03.01.1996"),
        ("Value 'n/a' cannot be converted to Decimal.", "97;2;n/a;;04.01.1996")]
    assert result.accepted().count() == 2
    assert "SortAggregate" not in first_leads(result.rows)._jdf.queryExecution().executedPlan().toString()
