"""Registered queries for SQL text and for functions that SQL users of SQLite know."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog.tables import show_tables, table
from gridloom.cluster import hadoop_path, scratch_dir
from gridloom.functions import sqlite
from gridloom.plans.workspace import Workspace, prepare_session, run_script


def _sql(text: str, *names: str):
    """A statement as a workspace's users write it, over the given tables."""
    def query(spark, sf):
        show_tables(spark, sf, *names)
        return Workspace(spark, scratch_dir(spark, "workspace")).sql(text)
    return query


_QUERY = """SELECT c_mktsegment, count(*) AS order_count, count(DISTINCT c_custkey) AS customer_count,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total_price
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY c_mktsegment"""

_JOINS = """SELECT c.c_custkey, c.c_name, o.o_orderkey, n.n_name, s.s_suppkey
    FROM customer c
    INNER JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'
    LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey"""

_RIGHT_JOIN = """SELECT o.o_orderkey, c.c_custkey, c.c_name
    FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000"""

_PREDICATES = """SELECT o_orderkey, o_orderstatus,
    CASE WHEN o_totalprice >= 300000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'middle' ELSE 'small' END AS size_class
    FROM orders o
    WHERE (o_orderstatus IN ('O', 'F') OR o_orderpriority {like} '1-urg%')
      AND NOT o_custkey BETWEEN 100 AND 200 AND o_orderdate IS NOT NULL
      AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0)"""

_GROUPS = """SELECT DISTINCT l_returnflag, l_linestatus, count(*) AS line_count, min(l_quantity) AS least,
    max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10
    ORDER BY l_returnflag DESC, l_linestatus LIMIT 4 OFFSET 1"""

_UNIONS = """SELECT c_nationkey AS nation, 'customer' AS side FROM customer
    UNION SELECT s_nationkey, 'supplier' FROM supplier
    UNION ALL SELECT n_nationkey, 'nation' FROM nation"""

_RECURSIVE = """WITH RECURSIVE tree(key, depth) AS (
        SELECT c_custkey, 0 FROM customer WHERE c_custkey < 10
        UNION ALL
        SELECT c.c_custkey, t.depth + 1 FROM tree t JOIN customer c ON c.c_custkey {div} 10 = t.key AND c.c_custkey >= 10)
    SELECT depth, count(*) AS key_count, min(key) AS first_key, max(key) AS last_key FROM tree GROUP BY depth"""

_WINDOWS = """WITH monthly AS (
        SELECT n_name, {month} AS month, count(*) AS order_count
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT n_name, month, order_count,
        CAST(row_number() OVER (PARTITION BY n_name ORDER BY order_count DESC, month) AS BIGINT) AS position,
        CAST(rank() OVER (PARTITION BY n_name ORDER BY order_count DESC) AS BIGINT) AS place,
        CAST(dense_rank() OVER (PARTITION BY n_name ORDER BY order_count DESC) AS BIGINT) AS step
    FROM monthly"""


def sql_script(spark, sf):
    """Several statements; the last result counts."""
    show_tables(spark, sf, "orders", "customer")
    return run_script(spark, [
        "CREATE OR REPLACE TEMPORARY VIEW big_orders AS SELECT * FROM orders WHERE o_totalprice > 250000",
        "SELECT count(*) AS ignored FROM big_orders",
        "CREATE OR REPLACE TEMPORARY VIEW big_buyers AS SELECT DISTINCT o_custkey FROM big_orders",
        "SELECT c_mktsegment, count(*) AS buyer_count FROM customer JOIN big_buyers ON c_custkey = o_custkey GROUP BY 1",
    ])


def sql_ctas(spark, sf):
    """A table made from a query, then added to, then read."""
    show_tables(spark, sf, "orders")
    folder = scratch_dir(spark, "table")
    name = folder.rsplit("/", 1)[-1].replace("-", "_")
    return run_script(spark, [
        f"CREATE TABLE {name} USING parquet LOCATION '{folder}' AS "
        "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O'",
        f"INSERT INTO {name} SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'",
        f"CREATE OR REPLACE TEMPORARY VIEW {name}_view AS SELECT o_custkey, count(*) AS order_count FROM {name} GROUP BY o_custkey",
        f"SELECT * FROM {name}_view",
    ])


def workspace_sql(spark, sf):
    """Tables kept in a folder, opened again and queried."""
    folder = scratch_dir(spark, "workspace")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    Workspace(spark, folder).save("kept_parts", parts)
    return Workspace(spark, folder).sql(
        "SELECT p_brand, count(*) AS part_count, max(P_SIZE) AS largest FROM KEPT_PARTS GROUP BY p_brand")


def _text(statement: str, *names: str):
    """A statement in the words of SQLite's users."""
    def query(spark, sf):
        prepare_session(spark)
        show_tables(spark, sf, *names)
        return run_script(spark, statement)
    return query


_GROUP_CONCAT = """SELECT o_orderstatus, GROUP_CONCAT(DISTINCT o_orderpriority) AS kinds, -- GROUP_CONCAT(x)
    group_concat(DISTINCT substr(o_orderpriority, 1, 1), '; ') AS firsts, 'GROUP_CONCAT(a)' AS said
    FROM orders GROUP BY o_orderstatus"""
_TOTAL = """SELECT l_returnflag, TOTAL(l_linenumber) AS numbers, total(CASE WHEN l_quantity > 100 THEN l_quantity END) AS nothing
    FROM lineitem GROUP BY l_returnflag"""
_GLOB = """SELECT p_partkey, p_name FROM part WHERE p_name GLOB '[a-r]* ?o*' AND p_brand NOT GLOB 'Brand#1*'
    AND /* GLOB 'x' */ p_type || 'it''s' GLOB '*it''s'"""
_LIKE = """SELECT p_partkey, p_name LIKE 'COLD%' AS cold, p_type NOT LIKE '%ECO_omy' AS other FROM part WHERE p_brand LIKE 'BRAND#%'"""
_TIME = "SELECT event_id, TIME(ts) AS time_of_day, strftime('%J', ts) = CAST(julianday(ts) AS TEXT) AS same_day FROM events"

_NAMES = """SELECT "o"."o_orderstatus" AS "order ""by"" status", [c_mktsegment], {building} AS building, {said} AS said,
    count("o_orderkey") AS "count of [o]" FROM "orders" AS "o" JOIN {customer} ON "o"."o_custkey" = "c_custkey"
    WHERE "o_orderstatus" <> {p} AND {nothing} IS NOT [o_orderpriority] GROUP BY [o].[o_orderstatus], "c_mktsegment" """
_BACKSLASH = r"""SELECT p_partkey, length('a\nb') AS four, p_name || '\' AS tail, replace(p_name, ' ', '\\') AS doubled,
    instr(p_name || '\t', '\') AS place, '\' || p_brand || '''\''' AS quoted, replace(p_name, ' ', '\') {like} '%\B%' AS low
    FROM part WHERE p_name <> 'it''s \'"""
_LIKE_BRACKETS = r"""SELECT p_partkey, p_name {like} ('COLD%') AS cold, p_name {like} ('c' || '%') AS c, NOT p_type {like} (('%ECO_omy')) AS other,
    CASE WHEN p_brand NOT {like} lower('BRAND#' || '1%') THEN p_type {like} '%' || 'BRASS' ELSE p_size = 1 END AS brass,
    {call} AS called, p_name {like} 'a!_%' ESCAPE '!' AS escaped, count(*) OVER (PARTITION BY p_brand {like} ('brand#5_')) AS alike
    FROM part WHERE p_type {like} ('%' || 'b' || 'r%') OR (p_name {like} '%o%' AND p_size {like} ('1_'))"""
_TOTAL_OVER = """SELECT l_orderkey, l_linenumber, l_partkey,
    TOTAL(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS running,
    total(l_quantity) FILTER (WHERE l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS returned,
    TOTAL(CASE WHEN l_quantity > 100 THEN 1 END) OVER w AS nothing FROM lineitem WHERE l_orderkey < 4000 WINDOW w AS (PARTITION BY l_linenumber)"""
_CONCAT_ORDERED = r"""SELECT l_orderkey, GROUP_CONCAT(l_partkey ORDER BY l_quantity DESC, l_partkey, l_suppkey) AS by_size,
    GROUP_CONCAT(l_returnflag || l_partkey, '\' ORDER BY l_partkey DESC, l_returnflag) FILTER (WHERE l_linestatus = 'F') AS shipped,
    GROUP_CONCAT(DISTINCT l_returnflag ORDER BY l_returnflag DESC) AS flags, TOTAL(DISTINCT l_linenumber) AS numbers,
    total(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS returned, GROUP_CONCAT(DISTINCT l_linenumber) FILTER (WHERE l_quantity > 25) AS large
    FROM lineitem GROUP BY l_orderkey"""
_CONCAT_OVER = """SELECT c_custkey, GROUP_CONCAT(c_custkey, '-') OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last,
    GROUP_CONCAT(c_custkey) FILTER (WHERE c_acctbal < 0) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS owing FROM customer"""
_DATE_MODIFIERS = """SELECT event_id, date(ts, '+1 month') AS month_later, datetime(ts, 'start of day', '-90 minutes') AS before,
    date(ts, 'weekday 1') AS monday, datetime(event_id * 1000, 'unixepoch') AS counted, date(ts, '-' || (event_id % 40) || ' days') AS back,
    strftime('%Y-%j', ts, '+1.5 days') AS third, time(ts, '-01:30') AS earlier, date('2024-02-29', '+1 year') AS no_leap,
    date(ts, 'start of month', '+1 month', '-1 day') AS month_end, unixepoch(ts, 'start of year') AS year_start,
    CAST(julianday(ts, 'start of day', '+12 hours') - julianday(ts, 'start of day') AS TEXT) AS half,
    date(ts, 'rubbish') IS NULL AS nothing, date('2024-13-01') IS NULL AS no_date FROM events"""
_CASTS = """SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 3) AS INTEGER) AS place, CAST(o_orderpriority AS REAL) AS real_place,
    CAST('x' || o_orderstatus AS INTEGER) AS none, CAST(NULLIF(o_orderstatus, 'O') AS NUMERIC) AS open, CAST(o_orderkey AS TEXT) AS key_text FROM orders"""

_SCRIPT = """-- big orders; and their buyers
CREATE OR REPLACE TEMPORARY VIEW script_orders AS SELECT * FROM orders WHERE o_totalprice > 250000;
SELECT count(*) AS ignored, ';' AS mark FROM script_orders; /* ; */
SELECT c_mktsegment, count(*) AS buyer_count, ';' AS mark FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM script_orders) GROUP BY c_mktsegment;
"""


def sql_script_mutation(spark, sf):
    """The result is what the SELECT saw, though its table grows and goes away after it."""
    show_tables(spark, sf, "orders")
    return Workspace(spark, scratch_dir(spark, "workspace")).script("""
        CREATE TABLE kept AS SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O';
        SELECT o_orderstatus, count(*) AS order_count FROM kept GROUP BY o_orderstatus;
        INSERT INTO kept SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F';
        DROP TABLE kept""")


def workspace_ctas(spark, sf):
    """A table that SQL makes in a workspace is in its folder, for the next one that opens it."""
    show_tables(spark, sf, "part")
    folder = scratch_dir(spark, "workspace")
    first = Workspace(spark, folder)
    first.sql("CREATE TABLE small AS SELECT p_partkey, p_brand FROM part WHERE p_size < 10")
    first.sql("INSERT INTO small SELECT p_partkey, p_brand FROM part WHERE p_size >= 40")
    moved = f"{folder}-moved"
    filesystem, source = hadoop_path(spark, folder)
    filesystem.rename(source, hadoop_path(spark, moved)[1])
    return Workspace(spark, moved).sql("SELECT p_brand, count(*) AS part_count FROM SMALL GROUP BY p_brand")


_DEEP = """WITH RECURSIVE walk(key, depth) AS (
        SELECT min(c_custkey), 0 FROM customer
        UNION ALL
        SELECT c.c_custkey, w.depth + 1 FROM walk w JOIN customer c ON c.c_custkey = w.key + 1 AND w.depth < 104)
    SELECT depth, key FROM walk"""


def sql_glob(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return parts.where(sqlite.glob(F.col("p_name"), "[a-r]* ?o*") & sqlite.glob(F.col("p_brand"), "Brand#[^1]*"))


def fn_agg(spark, sf):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("row_count"), F.sum("l_quantity").alias("quantity_sum"), F.avg("l_quantity").alias("quantity_avg"),
        F.min("l_extendedprice").alias("price_min"), F.max("l_extendedprice").alias("price_max"),
        F.sum(price).cast("double").alias("price_sum"),
        sqlite.total(F.when(F.col("l_quantity") > 100, F.col("l_quantity"))).alias("nothing_total"),
        sqlite.total(F.col("l_quantity")).alias("quantity_total"))


def fn_group_concat(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        sqlite.group_concat("l_partkey", ",", "l_partkey, l_suppkey").alias("parts"),
        sqlite.group_concat("CASE WHEN l_returnflag = 'R' THEN l_suppkey END", "; ").alias("returned"))


_STRINGS = """SELECT p_partkey, length(p_name) AS name_length, lower(p_brand) AS low, upper(p_name) AS up,
    trim('  ' || p_type || ' ') AS trimmed, ltrim('  ' || p_type || ' ') AS left_trimmed,
    rtrim('  ' || p_type || ' ') AS right_trimmed, substr(p_name, 2, 3) AS middle, substr(p_name, -3) AS tail,
    replace(p_name, ' ', '_') AS replaced, CAST(instr(p_name, ' ') AS BIGINT) AS blank_at,
    printf('%05d|%s|%.2f', p_partkey, p_brand, p_retailprice) AS printed FROM part"""

_NULLS = """SELECT c_custkey, abs(c_acctbal) AS size, round(c_acctbal) AS whole,
    nullif(c_mktsegment, 'BUILDING') AS segment, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment_or_none,
    ifnull(nullif(c_nationkey, 0), -1) AS nation, CAST(c_custkey AS {text}) AS key_text,
    {safe}(substr(c_name, 10) AS BIGINT) AS name_number, {safe}(c_mktsegment AS BIGINT) AS no_number,
    {kind} AS balance_type FROM customer"""


def fn_date(spark, sf):
    prepare_session(spark)
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", sqlite.date_text(ts).alias("day"), sqlite.time_text(ts).alias("time_of_day"),
        sqlite.datetime_text(ts).alias("moment"), sqlite.julian_day(ts).alias("julian"), F.expr("julianday(ts)").alias("julian_sql"),
        sqlite.strftime("%Y/%m week day %w, %H.%M", ts).alias("spelled"),
        F.expr("strftime('%d.%m.%Y %j', ts)").alias("spelled_sql"), F.expr("datetime(ts)").alias("moment_sql"))


QUERIES = {
    "sql_query": _sql(_QUERY, "orders", "customer"),
    "sql_script": sql_script,
    "sql_ctas": sql_ctas,
    "sql_joins": _sql(_JOINS, "customer", "nation", "orders", "supplier"),
    "sql_right_join": _sql(_RIGHT_JOIN, "customer", "orders"),
    "sql_predicates": _sql(_PREDICATES.format(like="LIKE"), "orders", "customer"),
    "sql_glob": sql_glob,
    "sql_group_having": _sql(_GROUPS, "lineitem"),
    "sql_union": _sql(_UNIONS, "customer", "supplier", "nation"),
    "sql_recursive": _sql(_RECURSIVE.format(div="div"), "customer"),
    "sql_window": _sql(_WINDOWS.format(month="date_format(o_orderdate, 'yyyy-MM')"), "orders", "customer", "nation"),
    "workspace_sql": workspace_sql,
    "workspace_ctas": workspace_ctas,
    "sql_script_text": _text(_SCRIPT, "orders", "customer"),
    "sql_script_mutation": sql_script_mutation,
    "sql_recursive_deep": _sql(_DEEP, "customer"),
    "sql_group_concat": _text(_GROUP_CONCAT, "orders"),
    "sql_total": _text(_TOTAL, "lineitem"),
    "sql_glob_text": _text(_GLOB, "part"),
    "sql_like_case": _text(_LIKE, "part"),
    "sql_time": _text(_TIME, "events"),
    "sql_quoted_names": _sql(_NAMES.format(
        building='"c_mktsegment" = "BUILDING"', said='"no such word"', customer="[customer]", p='"P"', nothing='"nothing"'), "orders", "customer"),
    "sql_backslash": _sql(_BACKSLASH.format(like="LIKE"), "part"),
    "sql_like_brackets": _sql(_LIKE_BRACKETS.format(like="LIKE", call="like('%LINEN%', p_name)"), "part"),
    "sql_total_over": _sql(_TOTAL_OVER, "lineitem"),
    "sql_group_concat_ordered": _sql(_CONCAT_ORDERED, "lineitem"),
    "sql_group_concat_over": _sql(_CONCAT_OVER, "customer"),
    "sql_date_modifiers": _sql(_DATE_MODIFIERS, "events"),
    "sql_casts": _sql(_CASTS, "orders"),
    "fn_agg": fn_agg,
    "fn_group_concat": fn_group_concat,
    "fn_string": _sql(_STRINGS, "part"),
    "fn_math_null": _sql(_NULLS.format(text="TEXT", safe="try_cast", kind="typeof(c_acctbal)"), "customer"),
    "fn_date": fn_date,
}

ORACLES = {
    "sql_query": _QUERY,
    "sql_script": """SELECT c_mktsegment, count(*) AS buyer_count FROM customer JOIN (
        SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 250000) ON c_custkey = o_custkey GROUP BY 1""",
    "sql_ctas": """SELECT o_custkey, count(*) AS order_count FROM orders WHERE o_orderstatus IN ('O', 'F')
        GROUP BY o_custkey""",
    "sql_joins": _JOINS,
    "sql_right_join": _RIGHT_JOIN,
    "sql_predicates": _PREDICATES.format(like="ILIKE"),
    "sql_glob": """SELECT p_partkey, p_name, p_brand FROM part
        WHERE regexp_matches(p_name, '^[a-r].* .o.*$') AND regexp_matches(p_brand, '^Brand#[^1].*$')""",
    "sql_group_having": _GROUPS,
    "sql_union": _UNIONS,
    "sql_recursive": _RECURSIVE.format(div="//"),
    "sql_window": _WINDOWS.format(month="strftime(o_orderdate, '%Y-%m')"),
    "workspace_ctas": """SELECT p_brand, count(*) AS part_count FROM part WHERE p_size < 10 OR p_size >= 40 GROUP BY p_brand""",
    "sql_script_text": """SELECT c_mktsegment, count(*) AS buyer_count, ';' AS mark FROM customer
        WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) GROUP BY c_mktsegment""",
    "sql_script_mutation": """SELECT o_orderstatus, count(*) AS order_count FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderstatus""",
    "sql_recursive_deep": "SELECT CAST(c_custkey AS INTEGER) AS depth, c_custkey AS key FROM customer WHERE c_custkey <= 104",
    "sql_group_concat": """SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS kinds,
        string_agg(DISTINCT substr(o_orderpriority, 1, 1), '; ' ORDER BY substr(o_orderpriority, 1, 1)) AS firsts,
        'GROUP_CONCAT(a)' AS said FROM orders GROUP BY o_orderstatus""",
    "sql_total": """SELECT l_returnflag, CAST(sum(l_linenumber) AS DOUBLE) AS numbers, CAST(0 AS DOUBLE) AS nothing FROM lineitem
        GROUP BY l_returnflag""",
    "sql_glob_text": """SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-r].* .o.*$') AND NOT starts_with(p_brand, 'Brand#1')""",
    "sql_like_case": """SELECT p_partkey, p_name ILIKE 'COLD%' AS cold, p_type NOT ILIKE '%ECO_omy' AS other FROM part WHERE p_brand ILIKE 'BRAND#%'""",
    "sql_time": "SELECT event_id, strftime(ts, '%H:%M:%S') AS time_of_day, true AS same_day FROM events",
    "sql_quoted_names": _NAMES.replace("[c_mktsegment]", '"c_mktsegment"').replace("[o].[o_orderstatus]", "o.o_orderstatus").replace(
        "IS NOT [o_orderpriority]", "IS DISTINCT FROM o_orderpriority").format(
        building="c_mktsegment = 'BUILDING'", said="'no such word'", customer="customer", p="'P'", nothing="'nothing'"),
    "sql_backslash": _BACKSLASH.format(like="ILIKE"),
    "sql_like_brackets": _LIKE_BRACKETS.format(like="ILIKE", call="p_name ILIKE '%LINEN%'").replace("p_size ILIKE", "CAST(p_size AS VARCHAR) ILIKE"),
    "sql_total_over": """SELECT l_orderkey, l_linenumber, l_partkey,
        CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS DOUBLE) AS running,
        CAST(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R') OVER (PARTITION BY l_orderkey), 0) AS DOUBLE) AS returned,
        CAST(0 AS DOUBLE) AS nothing FROM lineitem WHERE l_orderkey < 4000""",
    "sql_group_concat_ordered": r"""SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_quantity DESC, l_partkey, l_suppkey) AS by_size,
        string_agg(l_returnflag || l_partkey, '\' ORDER BY l_partkey DESC, l_returnflag) FILTER (l_linestatus = 'F') AS shipped,
        array_to_string(list_reverse_sort(list(DISTINCT l_returnflag)), ',') AS flags,
        CAST(sum(DISTINCT l_linenumber) AS DOUBLE) AS numbers,
        CAST(coalesce(sum(l_linenumber) FILTER (l_returnflag = 'R'), 0) AS DOUBLE) AS returned,
        nullif(array_to_string(list_sort(list(DISTINCT CAST(l_linenumber AS VARCHAR)) FILTER (l_quantity > 25)), ','), '') AS large
        FROM lineitem GROUP BY l_orderkey""",
    "sql_group_concat_over": """SELECT c_custkey,
        string_agg(CAST(c_custkey AS VARCHAR), '-') OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last,
        string_agg(CASE WHEN c_acctbal < 0 THEN CAST(c_custkey AS VARCHAR) END, ',') OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS owing FROM customer""",
    "sql_date_modifiers": """SELECT event_id,
        strftime(date_trunc('month', ts) + INTERVAL 1 MONTH + (day(ts) - 1) * INTERVAL 1 DAY, '%Y-%m-%d') AS month_later,
        strftime(date_trunc('day', ts) - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS before,
        strftime(ts + ((8 - dayofweek(ts)) % 7) * INTERVAL 1 DAY, '%Y-%m-%d') AS monday,
        strftime(make_timestamp(event_id * 1000000000), '%Y-%m-%d %H:%M:%S') AS counted,
        strftime(ts - (event_id % 40) * INTERVAL 1 DAY, '%Y-%m-%d') AS back, strftime(ts + INTERVAL 36 HOUR, '%Y-%j') AS third,
        strftime(ts - INTERVAL 90 MINUTE, '%H:%M:%S') AS earlier, '2025-03-01' AS no_leap,
        strftime(last_day(ts), '%Y-%m-%d') AS month_end, CAST(epoch(date_trunc('year', ts)) AS BIGINT) AS year_start,
        '0.5' AS half, true AS nothing, true AS no_date FROM events""",
    "sql_casts": """SELECT o_orderkey, CAST(coalesce(try_cast(regexp_extract(o_orderpriority, '^[0-9]+') AS BIGINT), 0) AS BIGINT) AS place,
        coalesce(try_cast(regexp_extract(o_orderpriority, '^[0-9]+') AS DOUBLE), 0) AS real_place, CAST(0 AS BIGINT) AS none,
        CASE WHEN o_orderstatus <> 'O' THEN CAST(0 AS DOUBLE) END AS open, CAST(o_orderkey AS VARCHAR) AS key_text FROM orders""",
    "workspace_sql": """SELECT p_brand, count(*) AS part_count, max(p_size) AS largest FROM part GROUP BY p_brand""",
    "fn_agg": """SELECT l_returnflag, l_linestatus, count(*) AS row_count, sum(l_quantity) AS quantity_sum,
        avg(l_quantity) AS quantity_avg, min(l_extendedprice) AS price_min, max(l_extendedprice) AS price_max,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS price_sum,
        CAST(0 AS DOUBLE) AS nothing_total, sum(l_quantity) AS quantity_total
        FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "fn_group_concat": """SELECT l_orderkey,
        string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey, l_suppkey) AS parts,
        string_agg(CAST(l_suppkey AS VARCHAR), '; ' ORDER BY l_suppkey) FILTER (l_returnflag = 'R') AS returned
        FROM lineitem GROUP BY l_orderkey""",
    "fn_string": _STRINGS,
    "fn_math_null": _NULLS.format(text="VARCHAR", safe="try_cast", kind="'double'"),
    "fn_date": """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S') AS time_of_day,
        strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment, ((epoch_us(ts) + 500) // 1000 + 210866760000000) / 86400000.0 AS julian, julian AS julian_sql,
        strftime(ts, '%Y/%m week day %w, %H.%M') AS spelled, strftime(ts, '%d.%m.%Y %j') AS spelled_sql,
        strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment_sql FROM events""",
}
