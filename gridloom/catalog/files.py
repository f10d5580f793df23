"""Registered queries for files: tables are written as delimited text and read back.

Files go to the shared scratch folder, in as many parts as Spark has tasks.
"""

from __future__ import annotations

import functools
import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.catalog.tables import table
from gridloom.cluster import hadoop_path, list_paths, path_exists, scratch_dir
from gridloom.functions.text import cell_text, encode_bytes
from gridloom.operators.ingest import ColumnMapping, Staged, ingest, preview, promote, stage, typed_rows
from gridloom.sinks.export import export_csv
from gridloom.sinks.materialize import compact, materialize
from gridloom.sources.archive import archive_lines, archive_records
from gridloom.sources.delimited import Dialect, parse_records
from gridloom.sources.dialect import profile
from gridloom.streaming.watch import watch_folder, watched

# One row in so many is broken on purpose.
BROKEN_EVERY = 97


def _line(df: DataFrame, *names: str, delimiter: str = ";") -> Column:
    """Columns as one line of text, without quoting."""
    return F.concat_ws(delimiter, *[cell_text(F.col(n), df.schema[n].dataType) for n in names])


_WRITTEN: dict[tuple, str] = {}


def _once(write):
    """Input files of a query are written once for each session and data folder, so that timing sees the query."""
    @functools.wraps(write)
    def folder(spark, sf, *more):
        key = (write.__name__, spark.sparkContext.applicationId, sf, *more)
        if key not in _WRITTEN or not path_exists(spark, _WRITTEN[key]):
            _WRITTEN[key] = write(spark, sf, *more)
        return _WRITTEN[key]
    return folder


def _write_lines(lines: DataFrame, target: str, header: str, partition: str | None = None) -> str:
    """Raw lines as files that each start with the header line."""
    writer = lines.withColumnRenamed("line", header).write.options(
        header=True, sep="\x01", quote="", escape="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    (writer.partitionBy(partition) if partition else writer).csv(target)
    return target


# Round trips

def csv_roundtrip(spark, sf):
    target = export_csv(table(spark, sf, "customer"), scratch_dir(spark, "csv"), ";", protect_formulas=False)
    mappings = [
        ColumnMapping(0, "c_custkey", "Integer"), ColumnMapping(1, "c_name"), ColumnMapping(2, "c_nationkey", "Integer"),
        ColumnMapping(3, "c_acctbal", "Decimal"), ColumnMapping(4, "c_mktsegment")]
    return ingest(spark, target, scratch_dir(spark, "staged"), mappings=mappings).accepted()


@_once
def _dated_orders(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return export_csv(orders, scratch_dir(spark, "csv"), "\t")


def csv_roundtrip_dates(spark, sf):
    target = _dated_orders(spark, sf)
    mappings = [ColumnMapping(0, "o_orderkey", "Integer"), ColumnMapping(1, "o_totalprice", "Decimal"),
                ColumnMapping(2, "o_orderdate", "Date")]
    back = ingest(spark, target, scratch_dir(spark, "staged"), mappings=mappings).accepted()
    return back.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


def csv_roundtrip_quoted(spark, sf):
    """Whole document texts, with quotes and line breaks inside cells."""
    documents = table(spark, sf, "documents").select("doc_id", "lang", "text")
    target = export_csv(documents, scratch_dir(spark, "csv"), ",", protect_formulas=False)
    back = ingest(spark, target, scratch_dir(spark, "staged"), trim=False).accepted()
    return back.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.md5("text").alias("text_md5"),
        F.length("text").alias("text_length"))


# Ingest rules

@_once
def _broken_orders(spark, sf):
    """Orders as lines; the broken ones lack a field or have one too many."""
    orders = table(spark, sf, "orders")
    line = _line(orders, "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    short = _line(orders, "o_orderkey", "o_custkey", "o_orderstatus")
    broken = F.col("o_orderkey") % BROKEN_EVERY == 0
    kind = F.when(broken & (F.col("o_orderkey") % 2 == 0), short).when(broken, F.concat(line, F.lit(";surplus")))
    return _write_lines(orders.select(F.coalesce(kind, line).alias("line")), scratch_dir(spark, "lines"),
                        "o_orderkey;o_custkey;o_orderstatus;o_orderpriority")


_ORDER_LINES = Dialect.named("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", delimiter=";")


def csv_quarantine(spark, sf):
    staged = ingest(spark, _broken_orders(spark, sf), scratch_dir(spark, "staged"), _ORDER_LINES)
    return staged.rejected().select("message", "raw_row")


def csv_accepted(spark, sf):
    return ingest(spark, _broken_orders(spark, sf), scratch_dir(spark, "staged"), _ORDER_LINES).accepted()


@_once
def _typed_lines(spark, sf):
    """Line items spelled the Polish way: decimal commas, tak and nie, day first."""
    lines = table(spark, sf, "lineitem")
    price = F.translate(cell_text(F.col("l_extendedprice"), lines.schema["l_extendedprice"].dataType), ".", ",")
    bad = F.col("l_orderkey") % BROKEN_EVERY == 0
    line = F.concat_ws(
        ";", F.col("l_orderkey").cast("string"),
        F.when(bad & (F.col("l_linenumber") == 1), "first").otherwise(F.col("l_linenumber").cast("string")),
        F.when(bad & (F.col("l_linenumber") == 2), "n/a").otherwise(price),
        F.when(F.col("l_returnflag") == "N", "").when(F.col("l_linestatus") == "O", "tak").otherwise("nie"),
        F.date_format("l_shipdate", "dd.MM.yyyy"))
    return _write_lines(lines.select(line.alias("line")), scratch_dir(spark, "lines"), "order;line;price;open;shipped")


_TYPED = [ColumnMapping(0, "order_id", "Integer"), ColumnMapping(1, "line_id", "Integer"),
          ColumnMapping(2, "price", "Decimal"), ColumnMapping(3, "is_open", "Boolean"), ColumnMapping(4, "shipped", "Date")]


def typed_convert(spark, sf):
    staged = ingest(spark, _typed_lines(spark, sf), scratch_dir(spark, "staged"), mappings=_TYPED)
    return staged.accepted().withColumn("shipped", F.date_format("shipped", "yyyy-MM-dd"))


def typed_quarantine(spark, sf):
    staged = ingest(spark, _typed_lines(spark, sf), scratch_dir(spark, "staged"), mappings=_TYPED)
    return staged.rejected().select("message", "raw_row")


def column_mapping(spark, sf):
    target = export_csv(table(spark, sf, "part"), scratch_dir(spark, "csv"), ",")
    mappings = [
        ColumnMapping(4, "Part size", "Integer"), ColumnMapping(0, "id", "Integer"), ColumnMapping(1, "Name"),
        ColumnMapping(2, "unused", include=False), ColumnMapping(3, "name")]
    return ingest(spark, target, scratch_dir(spark, "staged"), mappings=mappings).accepted()


def _padded(spark, sf, trim):
    customer = table(spark, sf, "customer")
    name = F.concat(F.lit("  "), F.col("c_name"), F.lit("   "))
    padded = customer.select("c_custkey", name.alias("c_name"), F.lit("").alias("empty"))
    target = export_csv(padded, scratch_dir(spark, "csv"), ";")
    back = ingest(spark, target, scratch_dir(spark, "staged"), trim=trim,
                  dialect=Dialect.named("c_custkey", "c_name", "empty", delimiter=";"))
    return back.accepted().select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.length("c_name").alias("name_length"), "empty")


def trim_fields(spark, sf):
    return _padded(spark, sf, True)


def trim_off(spark, sf):
    return _padded(spark, sf, False)


def ingest_manifest(spark, sf):
    """Files are laid out by kind; the manifest of all files is summed up by kind."""
    events = table(spark, sf, "events")
    line = F.when(F.col("event_id") % BROKEN_EVERY == 0, F.col("event_id").cast("string")).otherwise(
        _line(events, "event_id", "user_id", "value"))
    target = _write_lines(events.select("event_type", line.alias("line")), scratch_dir(spark, "lines"),
                          "event_id;user_id;value", partition="event_type")
    dialect = Dialect.named("event_id", "user_id", "value", delimiter=";")
    manifest = ingest(spark, target, scratch_dir(spark, "staged"), dialect).manifest()
    return manifest.groupBy(
        F.regexp_extract("source_file", "event_type=([^/]+)/", 1).alias("kind"),
        F.array_join("column_names", ",").alias("column_names"),
    ).agg(F.sum("row_count").alias("row_count"), F.sum("rejected_count").alias("rejected_count"))


def csv_preview(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    target = export_csv(orders.orderBy("o_orderkey"), scratch_dir(spark, "csv"), ";")
    return preview(spark, list_paths(spark, target)[0])


def stage_promote(spark, sf):
    target = export_csv(table(spark, sf, "customer"), scratch_dir(spark, "csv"), ",", protect_formulas=False)
    staged = ingest(spark, target, scratch_dir(spark, "staged"))
    final = promote(staged, [ColumnMapping(4, "segment"), ColumnMapping(1, "customer"), ColumnMapping(0, "id")])
    folder = scratch_dir(spark, "final")
    final.write.parquet(folder)
    return spark.read.parquet(folder)


@_once
def _dialects(spark, sf):
    """Customers by region in three delimiters, and without header in windows-1250."""
    region = table(spark, sf, "region")
    nation = table(spark, sf, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "r_name", "c_custkey", "c_name", "c_acctbal")
    root = scratch_dir(spark, "dialects")
    for name, mark in (("semicolon", ";"), ("comma", ","), ("tab", "\t")):
        lines = customers.select("r_name", _line(customers, "c_custkey", "c_name", "c_acctbal", delimiter=mark).alias("line"))
        _write_lines(lines, f"{root}/{name}", mark.join(("Nr", "Customer name", "Balance")), partition="r_name")
    polish = encode_bytes(F.concat_ws(";", F.lit("Łódź"), F.col("c_name"), F.lit("")), "windows-1250")
    customers.select("r_name", polish.alias("line")).write.partitionBy("r_name").text(f"{root}/polish")
    return root


def dialect_profile(spark, sf):
    found = profile(spark, list_paths(spark, _dialects(spark, sf)))
    return found.select(
        F.regexp_extract("source_file", "/([^/]+)/r_name=", 1).alias("kind"),
        F.regexp_replace(F.regexp_extract("source_file", "r_name=([^/]+)/", 1), "%20", " ").alias("region"),
        F.when(F.col("delimiter") == "\t", "tab").otherwise(F.col("delimiter")).alias("delimiter"),
        "encoding", "has_header", "has_preamble", "trailing_empty", "quoted_newlines",
        F.array_join("column_names", ",").alias("column_names"),
    ).distinct()


# Archives

def _customer_archives(spark, sf, line_breaks=False):
    """One archive per thousand customers: two CSV entries, one of them nested, and a note."""
    customer = table(spark, sf, "customer")
    if line_breaks:
        customer = customer.withColumn("c_name", F.concat(F.lit('"'), "c_name", F.lit("\n"), F.col("c_custkey"), F.lit('"')))
    lines = customer.select(
        F.floor(F.col("c_custkey") / 1000).alias("chunk"), "c_custkey",
        _line(customer, "c_custkey", "c_name", "c_mktsegment").alias("line"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c_custkey")
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, odd in (("even.csv", 0), ("nested/ODD.CSV", 1)):
                body = ["id;name;segment", *pdf.loc[pdf["c_custkey"] % 2 == odd, "line"]]
                archive.writestr(name, "\r\n".join(body) + "\r\n")
            archive.writestr("readme.txt", "id;name;segment")
        return pd.DataFrame({"path": [f"customers-{pdf['chunk'].iloc[0]}.zip"], "content": [packed.getvalue()]})

    return lines.groupBy("chunk").applyInPandas(pack, "path string, content binary")


def zip_lines(spark, sf):
    return archive_lines(_customer_archives(spark, sf)).groupBy("archive", "entry").agg(
        F.count("*").alias("line_count"))


def zip_ingest(spark, sf):
    dialect = Dialect.named("id", "name", "segment", delimiter=";")
    records = archive_records(archive_lines(_customer_archives(spark, sf)))
    folder = scratch_dir(spark, "staged")
    stage(typed_rows(parse_records(records, dialect), dialect), folder, dialect)
    return Staged.open(spark, folder).accepted()


# Sinks

def formula_guard(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.concat(F.lit("="), F.col("c_custkey")).alias("formula"))
    target = export_csv(customer, scratch_dir(spark, "csv"), ";", byte_order_mark=False)
    return spark.read.text(target).where(~F.col("value").startswith("c_custkey"))


def export_subset(spark, sf):
    target = export_csv(
        table(spark, sf, "lineitem"), scratch_dir(spark, "csv"), ",", header=False,
        columns=["L_ORDERKEY", "l_linenumber", "l_returnflag"], filters={"l_returnflag": ["R"], "l_linenumber": ["1", "2"]})
    return spark.read.text(target)


def export_sql_result(spark, sf):
    """A query result with cells that need quotes."""
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    result = spark.sql("""SELECT o_orderpriority || ',' || o_orderstatus AS kind, '"' || o_orderstatus || '"' AS state,
        count(*) AS order_count FROM orders GROUP BY o_orderpriority, o_orderstatus""")
    return spark.read.text(export_csv(result, scratch_dir(spark, "csv"), ",", header=False))


def materialize_rows(spark, sf):
    name = f"kept_{uuid.uuid4().hex}"
    materialize(table(spark, sf, "orders"), name, scratch_dir(spark, "table"),
                ["o_orderkey", "o_orderstatus"], {"o_orderstatus": ["O", "P"]})
    return spark.table(name)


def compact_check(spark, sf):
    folder = scratch_dir(spark, "many")
    table(spark, sf, "events").write.option("maxRecordsPerFile", 10_000).parquet(folder)
    return compact(spark, folder).select("row_count", "same_rows", (F.col("files_after") <= F.col("files_before")).alias("not_more_files"))


# Watched folders

_EVENTS = Dialect.named("event_id", "event_type", "value", delimiter=";")
_EVENT_TYPES = [ColumnMapping(0, "event_id", "Integer"), ColumnMapping(1, "event_type"), ColumnMapping(2, "value", "Decimal")]


def _event_files(spark, sf, target, condition="true"):
    """Events as CSV files; some have a value that is no number."""
    events = table(spark, sf, "events").where(condition)
    value = F.when(F.col("event_id") % BROKEN_EVERY == 0, "broken").otherwise(
        cell_text(F.col("value"), events.schema["value"].dataType))
    return export_csv(events.select("event_id", "event_type", value.alias("value")), target, ";",
                      protect_formulas=False, byte_order_mark=False)


def _watch(spark, folder, table_folder, checkpoint):
    watch_folder(spark, folder, table_folder, checkpoint, _EVENTS, _EVENT_TYPES, once=True).awaitTermination()
    return watched(spark, table_folder)


def stream_folder(spark, sf):
    folder = _event_files(spark, sf, scratch_dir(spark, "inbox"))
    return _watch(spark, folder, scratch_dir(spark, "table"), scratch_dir(spark, "check")).accepted()


def stream_no_repeat(spark, sf):
    """A second wave of files arrives between runs; every file is taken once."""
    folder = _event_files(spark, sf, scratch_dir(spark, "inbox"), "event_id % 3 <> 0")
    late = _event_files(spark, sf, scratch_dir(spark, "late"), "event_id % 3 = 0")
    table_folder, checkpoint = scratch_dir(spark, "table"), scratch_dir(spark, "check")
    _watch(spark, folder, table_folder, checkpoint)
    for path in list_paths(spark, late):
        filesystem, source = hadoop_path(spark, path)
        filesystem.rename(source, hadoop_path(spark, f"{folder}/late-{source.getName()}")[1])
    _watch(spark, folder, table_folder, checkpoint)
    staged = _watch(spark, folder, table_folder, checkpoint)
    return staged.accepted().groupBy("event_type").agg(
        F.count("*").alias("row_count"), F.count_distinct("event_id").alias("distinct_ids"))


def stream_quarantine(spark, sf):
    folder = _event_files(spark, sf, scratch_dir(spark, "inbox"))
    staged = _watch(spark, folder, scratch_dir(spark, "table"), scratch_dir(spark, "check"))
    return staged.rejected().select("message", "raw_row")


QUERIES = {
    "csv_roundtrip": csv_roundtrip,
    "csv_roundtrip_dates": csv_roundtrip_dates,
    "csv_roundtrip_quoted": csv_roundtrip_quoted,
    "csv_quarantine": csv_quarantine,
    "csv_accepted": csv_accepted,
    "typed_convert": typed_convert,
    "typed_quarantine": typed_quarantine,
    "column_mapping": column_mapping,
    "trim_fields": trim_fields,
    "trim_off": trim_off,
    "ingest_manifest": ingest_manifest,
    "preview": csv_preview,
    "stage_promote": stage_promote,
    "dialect_profile": dialect_profile,
    "zip_lines": zip_lines,
    "zip_ingest": zip_ingest,
    "formula_guard": formula_guard,
    "export_subset": export_subset,
    "export_sql_result": export_sql_result,
    "materialize": materialize_rows,
    "compact_check": compact_check,
    "stream_folder": stream_folder,
    "stream_no_repeat": stream_no_repeat,
    "stream_quarantine": stream_quarantine,
}

_BROKEN_ORDERS = f"""SELECT *, concat_ws(';', o_orderkey, o_custkey, o_orderstatus) AS short,
    o_orderkey % {BROKEN_EVERY} = 0 AS broken FROM orders"""
_TYPED_LINES = f"""SELECT *, l_orderkey % {BROKEN_EVERY} = 0 AND l_linenumber = 1 AS bad_line,
    l_orderkey % {BROKEN_EVERY} = 0 AND l_linenumber = 2 AS bad_price,
    CASE WHEN l_returnflag = 'N' THEN '' WHEN l_linestatus = 'O' THEN 'tak' ELSE 'nie' END AS open,
    replace(regexp_replace(CAST(l_extendedprice AS VARCHAR), '\\.0$', ''), '.', ',') AS price FROM lineitem"""

ORACLES = {
    "csv_roundtrip": """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment
        FROM customer""",
    "csv_roundtrip_dates": """SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate
        FROM orders""",
    "csv_roundtrip_quoted": """SELECT doc_id, lang, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS text_length
        FROM documents""",
    "csv_quarantine": f"""SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'Expected 4 fields, found 3.'
        ELSE 'Expected 4 fields, found 5.' END AS message,
        CASE WHEN o_orderkey % 2 = 0 THEN short ELSE short || ';' || o_orderpriority || ';surplus' END AS raw_row
        FROM ({_BROKEN_ORDERS}) WHERE broken""",
    "csv_accepted": f"""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
        o_orderstatus, o_orderpriority FROM ({_BROKEN_ORDERS}) WHERE NOT broken""",
    "typed_convert": f"""SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_id, l_extendedprice AS price,
        CASE open WHEN 'tak' THEN true WHEN 'nie' THEN false END AS is_open, strftime(l_shipdate, '%Y-%m-%d') AS shipped
        FROM ({_TYPED_LINES}) WHERE NOT bad_line AND NOT bad_price""",
    "typed_quarantine": f"""SELECT CASE WHEN bad_line THEN 'Value ''first'' cannot be converted to Integer.'
        ELSE 'Value ''n/a'' cannot be converted to Decimal.' END AS message,
        concat_ws(';', l_orderkey, CASE WHEN bad_line THEN 'first' ELSE CAST(l_linenumber AS VARCHAR) END,
            CASE WHEN bad_price THEN 'n/a' ELSE price END, open, strftime(l_shipdate, '%d.%m.%Y')) AS raw_row
        FROM ({_TYPED_LINES}) WHERE bad_line OR bad_price""",
    "column_mapping": """SELECT CAST(p_size AS BIGINT) AS "Part_size", p_partkey AS id, p_name AS "Name",
        p_type AS "name_2" FROM part""",
    "trim_fields": """SELECT c_custkey, c_name, CAST(length(c_name) AS INTEGER) AS name_length, '' AS empty FROM customer""",
    "trim_off": """SELECT c_custkey, '  ' || c_name || ' ' || chr(160) || chr(8195) AS c_name,
        CAST(length(c_name) + 5 AS INTEGER) AS name_length, '' AS empty FROM customer""",
    "ingest_manifest": f"""SELECT event_type AS kind, 'event_id,user_id,value' AS column_names,
        CAST(sum(CASE WHEN event_id % {BROKEN_EVERY} <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS row_count,
        CAST(sum(CASE WHEN event_id % {BROKEN_EVERY} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS rejected_count
        FROM events GROUP BY event_type""",
    "preview": """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
        CAST(NULL AS VARCHAR) AS ragged_row FROM orders ORDER BY orders.o_orderkey LIMIT 100""",
    "stage_promote": "SELECT c_mktsegment AS segment, c_name AS customer, CAST(c_custkey AS VARCHAR) AS id FROM customer",
    "dialect_profile": """WITH regions AS (SELECT DISTINCT r_name FROM customer JOIN nation ON c_nationkey = n_nationkey
            JOIN region ON n_regionkey = r_regionkey),
        kinds(kind, delimiter, encoding, has_header, trailing_empty, column_names) AS (VALUES
            ('semicolon', ';', 'utf-8', true, 0, 'Nr,Customer_name,Balance'),
            ('comma', ',', 'utf-8', true, 0, 'Nr,Customer_name,Balance'),
            ('tab', 'tab', 'utf-8', true, 0, 'Nr,Customer_name,Balance'),
            ('polish', ';', 'windows-1250', false, 1, 'Column1,Column2'))
        SELECT kind, r_name AS region, delimiter, encoding, has_header, false AS has_preamble,
            CAST(trailing_empty AS INTEGER) AS trailing_empty, false AS quoted_newlines, column_names
        FROM regions, kinds""",
    "zip_lines": """SELECT 'customers-' || (c_custkey // 1000) || '.zip' AS archive,
        CASE WHEN c_custkey % 2 = 0 THEN 'even.csv' ELSE 'nested/ODD.CSV' END AS entry,
        count(*) + 1 AS line_count FROM customer GROUP BY 1, 2""",
    "zip_ingest": "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment FROM customer",
    "formula_guard": """SELECT c_custkey || ';' || CASE WHEN c_acctbal < 0 THEN '''' ELSE '' END
        || regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '') || ';''=' || c_custkey AS value FROM customer""",
    "export_subset": """SELECT concat_ws(',', l_orderkey, l_linenumber, l_returnflag) AS value FROM lineitem
        WHERE l_returnflag = 'R' AND l_linenumber IN (1, 2)""",
    "export_sql_result": """SELECT '"' || o_orderpriority || ',' || o_orderstatus || '","\"\"' || o_orderstatus || '\"\"",'
        || count(*) AS value FROM orders GROUP BY o_orderpriority, o_orderstatus""",
    "materialize": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')",
    "compact_check": "SELECT count(*) AS row_count, true AS same_rows, true AS not_more_files FROM events",
    "stream_folder": f"SELECT event_id, event_type, value FROM events WHERE event_id % {BROKEN_EVERY} <> 0",
    "stream_no_repeat": f"""SELECT event_type, count(*) AS row_count, count(DISTINCT event_id) AS distinct_ids
        FROM events WHERE event_id % {BROKEN_EVERY} <> 0 GROUP BY event_type""",
    "stream_quarantine": f"""SELECT 'Value ''broken'' cannot be converted to Decimal.' AS message,
        event_id || ';' || event_type || ';broken' AS raw_row FROM events WHERE event_id % {BROKEN_EVERY} = 0""",
}
