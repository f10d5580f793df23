"""SQL text as SQLite's users write it: expected rows by SQLite's rules, written out."""

import pytest

from conftest import rows
from gridloom.plans.sqltext import analyzed, spark_text, tokens
from gridloom.plans.workspace import Workspace

BOATS = [
    (1, "Kaja", "Gdynia", "a\\b", "2024-01-31 10:20:30", 3.5), (2, "Mewa", "Gdynia", "100%", "2023-02-28", None),
    (3, "Kaja", "Hel", None, "12:30", -1.25), (4, "O'Hara", "gdynia x", "a_b", "junk", 2.0)]


@pytest.fixture(scope="module")
def harbour(spark, tmp_path_factory):
    space = Workspace(spark, str(tmp_path_factory.mktemp("harbour")))
    space.save("boats", spark.createDataFrame(BOATS, "Id bigint, Name string, Port string, `Odd Col` string, at string, load double"))
    return space


def one(space, statement):
    return [tuple(r) for r in space.sql(statement).collect()]


@pytest.mark.parametrize("statement, expected", [
    ('SELECT "Name", count(*) FROM boats GROUP BY "Name"', [("Kaja", 2), ("Mewa", 1), ("O'Hara", 1)]),
    ("SELECT count(*) FROM boats WHERE \"Port\" = 'Gdynia'", [(2,)]),
    ('SELECT count(*) FROM "boats"', [(4,)]),
    ("SELECT count(*) AS 'how many' FROM 'boats'", [(4,)]),
    ("SELECT [Name], [Odd Col] FROM [boats] WHERE [Id] < 3", [("Kaja", "a\\b"), ("Mewa", "100%")]),
    ('SELECT b."Name" FROM "boats" b JOIN boats c ON b."Id" = c."Id" WHERE c.`Port` = \'Hel\'', [("Kaja",)]),
    # no column of that name: a string, at that place only
    ('SELECT count(*) FROM boats WHERE Port = "Hel"', [(1,)]),
    ('SELECT "no such", "Name", "" FROM boats WHERE Id = 2', [("no such", "Mewa", "")]),
    ('SELECT "Name" FROM boats WHERE Id = 2 UNION ALL SELECT "Name" FROM (SELECT 1 AS other)', [("Mewa",), ("Name",)]),
    ('SELECT t."my ""id" FROM (SELECT "Id" "my ""id" FROM boats) t WHERE t."my ""id" = 2', [(2,)]),
    ('SELECT max(Id) "top" FROM boats GROUP BY "Port" HAVING count("Id") > 1 ORDER BY "top"', [(2,)]),
    (r"SELECT length('a\nb'), 'a\', '\\', [Odd Col] = 'a\b' FROM boats WHERE Id = 1", [(4, "a\\", "\\\\", True)]),
])
def test_names_and_strings(harbour, statement, expected):
    assert sorted(one(harbour, statement)) == sorted(expected)


def test_a_qualified_word_is_no_string(harbour):
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        harbour.sql('SELECT boats."nothing" FROM boats')
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        harbour.sql("SELECT nothing FROM boats")


@pytest.mark.parametrize("condition, ids", [
    ("Name LIKE ('k%')", [1, 3]), ("Name LIKE ('K' || '%')", [1, 3]), ("Name LIKE 'K' || '%'", [1, 3]),
    ("Name NOT LIKE ('k%') AND Port LIKE 'gdynia%'", [2, 4]), (r"[Odd Col] LIKE 'a\%'", [1]), (r"[Odd Col] LIKE '100\%' ESCAPE '\'", [2]),
    ("[Odd Col] LIKE ('a!' || '_b') ESCAPE '!'", [4]), ("like('k%', Name)", [1, 3]), ("NOT like('k%', Name)", [2, 4]), ("glob('K*', Name)", [1, 3]),
    ("Name GLOB ('k*')", []), ("Name LIKE upper('k') || '%' OR Id = 4", [1, 3, 4]), ("Name LIKE CASE WHEN Id > 1 THEN 'K%' ELSE 'x' END", [3]),
    ("[Odd Col] IS 'a_b' OR load IS NOT 2.0 AND load IS NOT NULL", [1, 3, 4]), ("[Odd Col] IS NOT 'a_b'", [1, 2, 3]), ("load IS NULL", [2]),
    ("Name = 'KAJA' COLLATE NOCASE", [1, 3]), ("Id = 0x3", [3]),
])
def test_predicates(harbour, condition, ids):
    assert [r[0] for r in one(harbour, f"SELECT Id FROM boats WHERE {condition} ORDER BY Id")] == ids


def test_limit_with_comma(harbour):
    assert one(harbour, "SELECT Id FROM boats ORDER BY Id LIMIT 1, 2") == [(2,), (3,)]
    assert one(harbour, "SELECT Id FROM boats ORDER BY Id LIMIT 2 OFFSET 1") == [(2,), (3,)]


@pytest.mark.parametrize("expression, value", [
    ("TOTAL(load)", 4.25), ("total(DISTINCT Id % 2)", 1.0), ("TOTAL(load) FILTER (WHERE Id > 1)", 0.75), ("TOTAL(load) FILTER (WHERE Id > 9)", 0.0),
    ("GROUP_CONCAT(Name ORDER BY Id DESC)", "O'Hara,Kaja,Mewa,Kaja"), ("GROUP_CONCAT(Name, '; ' ORDER BY Port DESC, Id)", "O'Hara; Kaja; Kaja; Mewa"),
    ("GROUP_CONCAT(DISTINCT Name ORDER BY Name DESC)", "O'Hara,Mewa,Kaja"), ("GROUP_CONCAT(DISTINCT Id ORDER BY Id DESC)", "4,3,2,1"),
    (r"GROUP_CONCAT(Id, '\' ORDER BY Id) FILTER (WHERE Id <> 2)", "1\\3\\4"), ("GROUP_CONCAT(Name) FILTER (WHERE Id > 9)", None),
    ("GROUP_CONCAT(DISTINCT Name) FILTER (WHERE Id > 9)", None), ("GROUP_CONCAT(CASE WHEN Id > 2 THEN Name END)", "Kaja,O'Hara"),
])
def test_aggregates(harbour, expression, value):
    assert one(harbour, f"SELECT {expression} FROM boats") == [(value,)]


def test_aggregates_over_windows(harbour):
    assert one(harbour, "SELECT Id, TOTAL(load) OVER (PARTITION BY Name ORDER BY Id) FROM boats ORDER BY Id") == [
        (1, 3.5), (2, 0.0), (3, 2.25), (4, 2.0)]
    assert one(harbour, "SELECT Id, TOTAL(load) FILTER (WHERE load > 0) OVER (ORDER BY Id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) "
                        "FROM boats ORDER BY Id") == [(1, 3.5), (2, 3.5), (3, 0.0), (4, 2.0)]
    assert one(harbour, "SELECT Id, GROUP_CONCAT(Name, '/') OVER w FROM boats WINDOW w AS (ORDER BY Id) ORDER BY Id") == [
        (1, "Kaja"), (2, "Kaja/Mewa"), (3, "Kaja/Mewa/Kaja"), (4, "Kaja/Mewa/Kaja/O'Hara")]
    assert one(harbour, "SELECT Id, GROUP_CONCAT([Odd Col]) OVER (PARTITION BY Name) FROM boats ORDER BY Id") == [
        (1, "a\\b"), (2, "100%"), (3, "a\\b"), (4, "a_b")]


@pytest.mark.parametrize("statement", [
    "SELECT TOTAL(DISTINCT load) OVER () FROM boats", "SELECT GROUP_CONCAT(DISTINCT Name) OVER () FROM boats",
    "SELECT GROUP_CONCAT(DISTINCT Name ORDER BY Id) FROM boats", "SELECT Name GLOB Port FROM boats", "SELECT count( FROM boats WHERE (TOTAL(x)"])
def test_refused(harbour, statement):
    with pytest.raises(Exception):
        harbour.sql(statement)


def test_dates_of_texts(harbour):
    assert one(harbour, "SELECT date(at), time(at), datetime(at) FROM boats ORDER BY Id") == [
        ("2024-01-31", "10:20:30", "2024-01-31 10:20:30"), ("2023-02-28", "00:00:00", "2023-02-28 00:00:00"),
        ("2000-01-01", "12:30:00", "2000-01-01 12:30:00"), (None, None, None)]
    assert one(harbour, "SELECT strftime('%d/%m', at, '-' || Id || ' days'), date(at, '+' || Id || ' months') FROM boats ORDER BY Id") == [
        ("30/01", "2024-03-02"), ("26/02", "2023-04-28"), ("29/12", "2000-04-01"), (None, None)]


@pytest.mark.parametrize("expression, value", [
    ("date('2024-01-31', '+1 month')", "2024-03-02"), ("date('2024-02-29', '+1 year')", "2025-03-01"), ("date('2024-01-31', '+1 month', '-1 day')", "2024-03-01"),
    ("datetime(1700000000, 'unixepoch')", "2023-11-14 22:13:20"), ("date(2460000.5)", "2023-02-25"), ("date(1700000000, 'auto')", "2023-11-14"),
    ("datetime('2024-01-01 00:00', '-00:30')", "2023-12-31 23:30:00"), ("date('2024-12-25', 'start of year', '+9 months', 'weekday 2')", "2024-10-01"),
    ("date('2024-03-05', 'weekday 2')", "2024-03-05"), ("date('2024-03-05', 'weekday 1')", "2024-03-11"), ("datetime('2024-03-05 06:07:08', 'start of day')", "2024-03-05 00:00:00"),
    ("datetime('2024-01-01T10:00:00+02:00')", "2024-01-01 08:00:00"), ("datetime('2024-01-01 10:00Z')", "2024-01-01 10:00:00"),
    ("time('10:11:12.5', '+90 seconds')", "10:12:42"), ("datetime('2024-01-01', '+1.5 hours')", "2024-01-01 01:30:00"), ("unixepoch('2024-01-01')", 1704067200),
    ("date('2024-13-01')", None), ("date('2024-01-01', 'rubbish')", None), ("date(NULL)", None), ("date('2024-01-01', NULL)", None),
    ("date('2024-01-10', '-' || 3 || ' days')", "2024-01-07"), ("date('2024-01-10', lower('START OF MONTH'))", "2024-01-01"),
    ("julianday('2024-01-01 12:00') - julianday('2023-12-31')", 1.5), ("strftime('%Y-%m', '2024-05-06', '-1 year')", "2023-05"),
    ("date('now') = strftime('%Y-%m-%d', 'now')", True), ("length(datetime())", 19), ("date(DATE '2024-02-03', '+1 day')", "2024-02-04"),
    ("CAST('12abc' AS INTEGER)", 12), ("CAST('abc' AS INTEGER)", 0), ("CAST(12.7 AS INTEGER)", 12), ("CAST(' 3.5x' AS REAL)", 3.5), ("CAST(NULL AS INTEGER)", None),
    ("CAST(5 AS TEXT)", "5"), ("CAST('-7' AS NUMERIC)", -7.0), ("0x1F", 31)])
def test_values(harbour, expression, value):
    assert one(harbour, f"SELECT {expression}") == [(value,)]


def test_statements_that_change_tables_run_once(spark, harbour):
    harbour.script("""CREATE TABLE made ("the key" INTEGER, word TEXT, size REAL);
        INSERT INTO "made" SELECT "Id", "fixed", load FROM boats""")
    assert rows(harbour.sql("SELECT * FROM made")) == [(1, "fixed", 3.5), (2, "fixed", None), (3, "fixed", -1.25), (4, "fixed", 2.0)]
    assert dict(harbour.sql("SELECT * FROM made").dtypes) == {"the key": "bigint", "word": "string", "size": "double"}


def test_indexes_of_spark_stay(spark):
    assert analyzed(spark, "SELECT split('a,b', ',')[1] AS x, array(1, 2)[0] AS y").first() == ("b", 1)
    assert [k for k, _ in tokens("a[0] [b] x(1)[2]")] == [
        "word", "other", "number", "other", "space", "bracketed", "space", "word", "other", "number", "other", "other", "number", "other"]
    assert spark_text("SELECT map['k'] FROM t WHERE a -> 'b' <> \"c\"") == "SELECT map['k'] FROM t WHERE a -> 'b' <> `c`"
