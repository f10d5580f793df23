"""Registered queries for files that are not plain: odd headers, quotes, encodings, archives, broken ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from gridloom.catalog.files import _EVENT_TYPES, _EVENTS, BROKEN_EVERY, _customer_archives, _event_files, _line, _write_lines
from gridloom.catalog.tables import table
from gridloom.cluster import hadoop_path, list_paths, scratch_dir
from gridloom.operators.ingest import Staged, ingest, ingest_by_layout, preview, stage, typed_rows
from gridloom.sinks.export import export_csv
from gridloom.sinks.materialize import compact
from gridloom.sources.archive import archive_lines, archive_records, read_archives
from gridloom.sources.delimited import Dialect, parse_records
from gridloom.sources.dialect import EMPTY_FILE
from gridloom.streaming.watch import watch_any, watch_folder, watched, watched_layouts


def _put(spark, path: str, content: bytes) -> None:
    filesystem, location = hadoop_path(spark, path)
    stream = filesystem.create(location)
    stream.write(bytearray(content))
    stream.close()


def _move_in(spark, source: str, target: str, name: str) -> None:
    """Data files of a written folder, moved into another one under a name and number."""
    filesystem, folder = hadoop_path(spark, target)
    filesystem.mkdirs(folder)
    for number, path in enumerate(list_paths(spark, source)):
        filesystem.rename(hadoop_path(spark, path)[1], hadoop_path(spark, f"{target}/{name}-{number}.csv")[1])


def _by_nation(spark, sf, top: dict[int, str], first_blank: int = 0) -> str:
    """Customers as a file for each nation, each with the same first lines; some with blank lines above."""
    customer = table(spark, sf, "customer")
    body = customer.select(F.col("c_nationkey").alias("n"), (F.col("c_custkey") + 1).alias("at"),
                           _line(customer, "c_custkey", "c_name", "c_acctbal").alias("line"))
    nations = body.select("n").distinct()
    blanks = nations.where(F.col("n") < first_blank).select("n", F.explode(F.sequence(F.lit(-200), F.lit(-101))).alias("at"), F.lit("").alias("line"))
    heads = [nations.select("n", F.lit(at).alias("at"), F.lit(line).alias("line")) for at, line in top.items()]
    rows = body.unionByName(blanks)
    for head in heads:
        rows = rows.unionByName(head)
    target = scratch_dir(spark, "nations")
    rows.repartition("n").sortWithinPartitions("n", "at").select("n", "line").write.partitionBy("n").text(target)
    return target


_CUSTOMER_HEAD = "c_custkey;c_name;c_acctbal"


def head_blank_lines(spark, sf):
    """Some files start with a hundred blank lines."""
    found = ingest_by_layout(spark, _by_nation(spark, sf, {-1: _CUSTOMER_HEAD}, first_blank=12), scratch_dir(spark, "tables"))
    rows = [staged.accepted() for staged in found.values()]
    assert len(rows) == 1, "all files have one layout"
    return rows[0]


def csv_preamble(spark, sf):
    """A line above the header says what the file is."""
    folder = _by_nation(spark, sf, {-2: "Report: customers of a nation", -1: _CUSTOMER_HEAD})
    return ingest(spark, folder, scratch_dir(spark, "staged")).accepted()


def col_batch(spark, sf):
    """A column named as the parts of watched tables once were."""
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 10).alias("batch"), "o_orderstatus")
    target = export_csv(orders, scratch_dir(spark, "csv"), ";")
    return ingest(spark, target, scratch_dir(spark, "staged")).accepted()


def csv_bare_quotes(spark, sf):
    """Sizes in inches: a quote inside a cell that no quote opens."""
    part = table(spark, sf, "part")
    line = F.concat_ws(";", "p_partkey", F.concat(F.col("p_size"), F.lit('" '), F.col("p_name")), F.concat(F.lit('"'), F.col("p_type"), F.lit('"')), "p_brand")
    target = _write_lines(part.select(line.alias("line")), scratch_dir(spark, "lines"), "key;size;kind;brand")
    return ingest(spark, target, scratch_dir(spark, "staged")).accepted()


_QUOTED_HEAD = '"o_orderkey";"o_custkey"; o_orderstatus '


def _order_lines(spark, sf, header: str, condition: str = "true") -> str:
    orders = table(spark, sf, "orders").where(condition)
    return _write_lines(orders.select(_line(orders, "o_orderkey", "o_custkey", "o_orderstatus").alias("line")),
                        scratch_dir(spark, "lines"), header)


_ORDERS = Dialect.named("o_orderkey", "o_custkey", "o_orderstatus", delimiter=";")


def csv_header_quoted(spark, sf):
    """Quoted and padded column names under a dialect that names them plainly."""
    return ingest(spark, _order_lines(spark, sf, _QUOTED_HEAD), scratch_dir(spark, "staged"), _ORDERS).accepted()


def csv_header_renamed(spark, sf):
    """The first record is the header where the caller says there is one, whatever its names."""
    return ingest(spark, _order_lines(spark, sf, "nr;kunde;stand"), scratch_dir(spark, "staged"), _ORDERS).accepted()


def stream_header_quoted(spark, sf):
    """Watched files of which some quote their header."""
    inbox = scratch_dir(spark, "inbox")
    _move_in(spark, _order_lines(spark, sf, "o_orderkey;o_custkey;o_orderstatus", "o_orderkey % 2 = 0"), inbox, "plain")
    _move_in(spark, _order_lines(spark, sf, _QUOTED_HEAD, "o_orderkey % 2 = 1"), inbox, "quoted")
    tables = scratch_dir(spark, "table")
    watch_folder(spark, inbox, tables, scratch_dir(spark, "check"), _ORDERS, once=True).awaitTermination()
    return watched(spark, tables).accepted()


def watch_bad_file(spark, sf):
    """An empty file and one of blank lines among good ones: each has a row, and the others are taken."""
    inbox = scratch_dir(spark, "inbox")
    _move_in(spark, _event_files(spark, sf, scratch_dir(spark, "events")), inbox, "events")
    _put(spark, f"{inbox}/empty.csv", b"")
    _put(spark, f"{inbox}/blank.csv", b"\n" * 200)
    named, tables = scratch_dir(spark, "named"), scratch_dir(spark, "tables")
    watch_folder(spark, inbox, named, scratch_dir(spark, "check"), _EVENTS, _EVENT_TYPES, once=True).awaitTermination()
    watch_any(spark, inbox, tables, scratch_dir(spark, "check"), once=True).awaitTermination()
    layouts = watched_layouts(spark, tables)

    def facts(way: str, kind: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("row_count")).select(F.lit(way).alias("way"), F.lit(kind).alias("kind"), "row_count")

    whole_files = watched(spark, named).rejected().where("row_number IS NULL")
    found = [facts("named", "accepted", watched(spark, named).accepted()), facts("named", "problem", whole_files)]
    found += [facts("any", "problem" if name == "problems" else "accepted",
                    staged.rejected() if name == "problems" else staged.accepted()) for name, staged in layouts.items()]
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def compact_watched_headers(spark, sf):
    """A watched table is compacted between waves of files, of which some name their columns otherwise."""
    inbox, tables, checkpoint = scratch_dir(spark, "inbox"), scratch_dir(spark, "table"), scratch_dir(spark, "check")
    for wave, header in enumerate(("o_orderkey;o_custkey;o_orderstatus", "nr;kunde;stand", _QUOTED_HEAD, "nr;kunde;stand")):
        _move_in(spark, _order_lines(spark, sf, header, f"o_orderkey % 4 = {wave}"), inbox, f"wave{wave}")
        watch_folder(spark, inbox, tables, checkpoint, _ORDERS, once=True).awaitTermination()
        compact(spark, tables)
    return watched(spark, tables).accepted()


def watch_many_empty(spark, sf):
    """Empty files beside good ones, met by several batches: each is noted once, and stays so when compacted."""
    inbox, tables, checkpoint = scratch_dir(spark, "inbox"), scratch_dir(spark, "table"), scratch_dir(spark, "check")
    for wave in range(3):
        _move_in(spark, _order_lines(spark, sf, "o_orderkey;o_custkey;o_orderstatus", f"o_orderkey % 3 = {wave}"), inbox, f"wave{wave}")
        for number in range(5):
            _put(spark, f"{inbox}/empty{wave}-{number}.csv", b"")
        watch_folder(spark, inbox, tables, checkpoint, _ORDERS, once=True).awaitTermination()
    compact(spark, tables)
    staged = watched(spark, tables)
    return staged.accepted().groupBy("o_orderstatus").agg(F.count("*").alias("row_count")).unionByName(
        staged.rejected().groupBy(F.col("message").alias("o_orderstatus")).agg(F.count("*").alias("row_count")))


def stream_changed_file(spark, sf):
    """A file that was taken is written anew, before new files come: its new rows replace the old ones."""
    inbox, tables, checkpoint = scratch_dir(spark, "inbox"), scratch_dir(spark, "table"), scratch_dir(spark, "check")
    head = "o_orderkey;o_custkey;o_orderstatus"
    for name, condition in (("early", "o_orderkey % 2 = 0"), ("wrong", "o_orderkey % 5 = 0")):
        _move_in(spark, _order_lines(spark, sf, head, condition), inbox, name)
    watch_folder(spark, inbox, tables, checkpoint, _ORDERS, once=True).awaitTermination()
    compact(spark, tables)
    filesystem, _ = hadoop_path(spark, inbox)
    for path in list_paths(spark, inbox):
        if "/wrong-" in path:
            filesystem.delete(hadoop_path(spark, path)[1], False)
            _put(spark, path, head.encode() + b"\n")
    late = _order_lines(spark, sf, head, "o_orderkey % 2 = 1")
    _move_in(spark, late, inbox, "late")
    watch_folder(spark, inbox, tables, checkpoint, _ORDERS, once=True).awaitTermination()
    return watched(spark, tables).accepted()


def compact_partitioned(spark, sf):
    """Parts of a table stay apart when it is compacted, so one more part can be added."""
    folder = scratch_dir(spark, "parts")
    events = table(spark, sf, "events").select("event_id", "event_type")
    events.write.option("maxRecordsPerFile", 10_000).partitionBy("event_type").parquet(folder)
    compact(spark, folder)
    events.where(f"event_id % {BROKEN_EVERY} = 0").select("event_id").write.parquet(f"{folder}/event_type=again")
    return spark.read.parquet(folder).groupBy("event_type").agg(F.count("*").alias("row_count"), F.sum("event_id").alias("id_sum"))


def csv_utf16(spark, sf):
    """The Unicode text that spreadsheets write: UTF-16 with a byte order mark."""
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("Nr"), F.concat(F.lit("Łódź "), "c_name").alias("Name"), F.col("c_mktsegment").alias("Segment"))
    target = scratch_dir(spark, "utf16")
    customer.write.options(encoding="UTF-16", sep="\t", header=True).csv(target)
    return ingest(spark, target, scratch_dir(spark, "staged")).accepted()


def zip_files(spark, sf):
    """Archive files, read as files are; a cell holds a line break."""
    packed = _customer_archives(spark, sf, line_breaks=True)
    folder = scratch_dir(spark, "zips")
    # the text sink writes the bytes of a string; the line end after them does not matter to an archive
    packed.select(F.regexp_replace("path", "[.]zip$", "").alias("name"), F.col("content").cast("string").alias("value")).write.partitionBy("name").text(folder)
    filesystem, _ = hadoop_path(spark, folder)
    for part in list_paths(spark, folder):
        for number, path in enumerate(list_paths(spark, part)):
            filesystem.rename(hadoop_path(spark, path)[1], hadoop_path(spark, f"{part}/{number}-{uuid.uuid4().hex}.ZIP")[1])
    dialect = Dialect.named("id", "name", "segment", delimiter=";", quoted_newlines=True)
    records = archive_records(archive_lines(read_archives(spark, folder)), quoted_newlines=True, delimiter=";")
    staged = scratch_dir(spark, "staged")
    stage(typed_rows(parse_records(records, dialect), dialect), staged, dialect)
    return Staged.open(spark, staged).accepted()


def preview_open_quote(spark, sf):
    """A quote that never closes in the first record: the preview shows what it has read, and reads on no further."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    ordered = orders.orderBy("o_orderkey")
    line = F.concat_ws(";", "o_orderkey", "o_custkey", F.concat(F.lit('"'), F.col("o_orderstatus")))
    target = _write_lines(ordered.select(line.alias("line")), scratch_dir(spark, "lines"), "o_orderkey;o_custkey;o_orderstatus")
    shown = preview(spark, list_paths(spark, target)[0], _ORDERS)
    return shown.select("o_orderkey", "o_custkey")


QUERIES = {
    "col_batch": col_batch,
    "head_blank_lines": head_blank_lines,
    "csv_preamble": csv_preamble,
    "csv_bare_quotes": csv_bare_quotes,
    "csv_header_quoted": csv_header_quoted,
    "csv_header_renamed": csv_header_renamed,
    "stream_header_quoted": stream_header_quoted,
    "watch_bad_file": watch_bad_file,
    "compact_partitioned": compact_partitioned,
    "compact_watched_headers": compact_watched_headers,
    "watch_many_empty": watch_many_empty,
    "stream_changed_file": stream_changed_file,
    "csv_utf16": csv_utf16,
    "zip_files": zip_files,
    "preview_open_quote": preview_open_quote,
}

_CUSTOMER_TEXT = """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
    regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '') AS c_acctbal FROM customer"""
_ORDER_TEXT = "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus FROM orders"

ORACLES = {
    "col_batch": """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_orderkey % 10 AS VARCHAR) AS batch, o_orderstatus
        FROM orders""",
    "head_blank_lines": _CUSTOMER_TEXT,
    "csv_preamble": _CUSTOMER_TEXT,
    "csv_bare_quotes": """SELECT CAST(p_partkey AS VARCHAR) AS key, p_size || '" ' || p_name AS size, p_type AS kind, p_brand AS brand
        FROM part""",
    "csv_header_quoted": _ORDER_TEXT,
    "csv_header_renamed": _ORDER_TEXT,
    "stream_header_quoted": _ORDER_TEXT,
    "watch_bad_file": f"""SELECT 'named' AS way, 'accepted' AS kind, count(*) AS row_count FROM events WHERE event_id % {BROKEN_EVERY} <> 0
        UNION ALL SELECT 'any', 'accepted', count(*) FROM events
        UNION ALL SELECT 'named', 'problem', 2 UNION ALL SELECT 'any', 'problem', 2""",
    "compact_watched_headers": _ORDER_TEXT,
    "watch_many_empty": f"""SELECT o_orderstatus, count(*) AS row_count FROM orders GROUP BY o_orderstatus
        UNION ALL SELECT '{EMPTY_FILE}', 15""",
    "stream_changed_file": _ORDER_TEXT,
    "compact_partitioned": f"""SELECT event_type, count(*) AS row_count, CAST(sum(event_id) AS BIGINT) AS id_sum FROM (
        SELECT event_type, event_id FROM events UNION ALL SELECT 'again', event_id FROM events WHERE event_id % {BROKEN_EVERY} = 0)
        GROUP BY event_type""",
    "csv_utf16": """SELECT CAST(c_custkey AS VARCHAR) AS "Nr", 'Łódź ' || c_name AS "Name", c_mktsegment AS "Segment" FROM customer""",
    "zip_files": """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || chr(10) || c_custkey AS name, c_mktsegment AS segment FROM customer""",
    "preview_open_quote": """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders
        ORDER BY orders.o_orderkey LIMIT 100""",
}
