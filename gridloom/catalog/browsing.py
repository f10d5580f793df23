"""Registered queries for filters, facets, pages and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog.tables import show_tables, table
from gridloom.operators.browse import facets, filtered_count, page, value_filter
from gridloom.operators.fences import Fences


def value_filter_text(spark, sf):
    return value_filter(table(spark, sf, "lineitem"), {"L_RETURNFLAG": ["R", "A"], "l_linestatus": ["O"]})


def value_filter_numeric(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return value_filter(lines, {"l_linenumber": ["1", "3", "x"], "l_quantity": ["12", "30.0"]})


def value_filter_null(spark, sf):
    kind = F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind")
    events = table(spark, sf, "events").select("event_id", "user_id", kind)
    return value_filter(events, {"kind": [None, "click"]})


def value_filter_as_text(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    return value_filter(parts, {"p_size": ["7", "11", "011"]}, as_text=True)


def value_filter_empty(spark, sf):
    return value_filter(table(spark, sf, "customer"), {"c_mktsegment": []})


def count_filtered(spark, sf):
    return filtered_count(table(spark, sf, "lineitem"), {"l_returnflag": ["R"], "l_linestatus": ["O", "F"]})


def column_facets(spark, sf):
    return facets(table(spark, sf, "lineitem"), "l_returnflag", {"l_linestatus": ["O"], "l_returnflag": ["R"]})


def column_facets_limited(spark, sf):
    return facets(table(spark, sf, "orders"), "o_custkey", {"o_orderstatus": ["O", "F"]})


def facet_search(spark, sf):
    return facets(table(spark, sf, "part"), "p_type", search="A")


def page_sorted(spark, sf):
    return page(table(spark, sf, "orders"), "o_totalprice", descending=True, offset=400, tie_break="o_orderkey")


def page_nulls_first(spark, sf):
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price")
    orders = table(spark, sf, "orders").select("o_orderkey", price)
    return page(orders, "price", offset=100, tie_break="o_orderkey")


def page_numbered(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return page(orders, "o_totalprice", limit=50, offset=50,
                tie_break="o_orderkey", numbered=True)


def page_deep(spark, sf):
    """A page from the middle of the table, reached by counting key ranges."""
    lines = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    middle = lines.count() // 2
    return page(lines, "o_orderstatus", offset=middle, tie_break="o_orderkey", top_k_rows=1000, numbered=True)


def page_text_tie(spark, sf):
    """A deep page, last key first, whose tie-break is a text."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("key"), "o_orderstatus")
    return page(orders, "o_orderstatus", descending=True, offset=orders.count() // 2, tie_break="key", top_k_rows=300, numbered=True)


def page_fences(spark, sf):
    """Two pages far down, of one order whose keys were counted once."""
    lines = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    fences = Fences.build(lines, "o_custkey", descending=True, tie_break="o_orderkey", filters={"o_orderstatus": ["O", "F"]}, fence_rows=500)
    middle = lines.count() // 3
    return fences.page(200, middle, numbered=True).unionByName(fences.page(100, middle * 2, numbered=True))


def page_unsorted_deep(spark, sf):
    """A page far down without an order: as many rows as it has, all of them the table's."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    found = page(lines, offset=lines.count() - 150, top_k_rows=1000)
    return found.join(lines.distinct(), ["l_orderkey", "l_linenumber"], "left_semi").agg(F.count("*").alias("row_count"))


def page_over_sql(spark, sf):
    show_tables(spark, sf, "orders")
    result = spark.sql("SELECT o_custkey, count(*) AS order_count FROM orders GROUP BY o_custkey")
    return page(result, "order_count", descending=True, filters={"order_count": ["9", "10", "11", "12"]},
                tie_break="o_custkey", offset=20, limit=100)


QUERIES = {
    "value_filter": value_filter_text,
    "value_filter_numeric": value_filter_numeric,
    "value_filter_null": value_filter_null,
    "value_filter_as_text": value_filter_as_text,
    "value_filter_empty": value_filter_empty,
    "filtered_count": count_filtered,
    "column_facets": column_facets,
    "column_facets_limited": column_facets_limited,
    "facet_search": facet_search,
    "page_sorted": page_sorted,
    "page_nulls_first": page_nulls_first,
    "page_numbered": page_numbered,
    "page_deep": page_deep,
    "page_text_tie": page_text_tie,
    "page_fences": page_fences,
    "page_unsorted_deep": page_unsorted_deep,
    "page_over_sql": page_over_sql,
}

ORACLES = {
    "value_filter": "SELECT * FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_linestatus = 'O'",
    "value_filter_numeric": """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
        WHERE l_linenumber IN (1, 3) AND l_quantity IN (12, 30)""",
    "value_filter_null": """SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN event_type END AS kind
        FROM events WHERE event_type IN ('error', 'click')""",
    "value_filter_as_text": """SELECT p_partkey, p_retailprice, p_size FROM part
        WHERE CAST(p_size AS VARCHAR) IN ('7', '11', '011')""",
    "value_filter_empty": "SELECT * FROM customer WHERE 1 = 0",
    "filtered_count": """SELECT count(*) AS total_rows FROM lineitem
        WHERE l_returnflag = 'R' AND l_linestatus IN ('O', 'F')""",
    "column_facets": """SELECT l_returnflag AS value, count(*) AS row_count FROM lineitem
        WHERE l_linestatus = 'O' GROUP BY 1 ORDER BY 1 LIMIT 500""",
    "column_facets_limited": """SELECT o_custkey AS value, count(*) AS row_count FROM orders
        WHERE o_orderstatus IN ('O', 'F') GROUP BY 1 ORDER BY 1 LIMIT 500""",
    "facet_search": """SELECT p_type AS value, count(*) AS row_count FROM part
        WHERE contains(lower(p_type), 'a') GROUP BY 1 ORDER BY 1 LIMIT 500""",
    "page_sorted": "SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 200 OFFSET 400",
    "page_nulls_first": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price
        FROM orders ORDER BY price NULLS FIRST, o_orderkey LIMIT 200 OFFSET 100""",
    "page_numbered": """SELECT o_orderkey, o_totalprice,
        row_number() OVER (ORDER BY o_totalprice NULLS FIRST, o_orderkey) AS row_number
        FROM orders ORDER BY o_totalprice NULLS FIRST, o_orderkey LIMIT 50 OFFSET 50""",
    "page_deep": """SELECT o_orderkey, o_custkey, o_orderstatus, row_number FROM (
        SELECT *, row_number() OVER (ORDER BY o_orderstatus NULLS FIRST, o_orderkey) AS row_number FROM orders)
        WHERE row_number > (SELECT count(*) // 2 FROM orders) AND row_number <= (SELECT count(*) // 2 FROM orders) + 200""",
    "page_text_tie": """SELECT key, o_orderstatus, row_number FROM (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus,
        row_number() OVER (ORDER BY o_orderstatus DESC, CAST(o_orderkey AS VARCHAR)) AS row_number, count(*) OVER () AS n FROM orders)
        WHERE row_number > n // 2 AND row_number <= n // 2 + 200""",
    "page_fences": """WITH numbered AS (
        SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER (ORDER BY o_custkey DESC NULLS LAST, o_orderkey) AS row_number
        FROM orders WHERE o_orderstatus IN ('O', 'F')), middle AS (SELECT count(*) // 3 AS n FROM orders)
        SELECT numbered.* FROM numbered, middle
        WHERE row_number > n AND row_number <= n + 200 OR row_number > 2 * n AND row_number <= 2 * n + 100""",
    "page_unsorted_deep": "SELECT least(150, count(*)) AS row_count FROM lineitem",
    "page_over_sql": """SELECT o_custkey, count(*) AS order_count FROM orders GROUP BY o_custkey
        HAVING count(*) IN (9, 10, 11, 12) ORDER BY order_count DESC, o_custkey LIMIT 100 OFFSET 20""",
}
