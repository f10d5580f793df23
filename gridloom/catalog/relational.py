"""Registered queries for duplicates, compare and join, with the same logic in plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog.tables import table
from gridloom.operators import compare as cmp
from gridloom.operators.compare import compare, status_counts
from gridloom.operators.duplicates import duplicate_rows, duplicate_summary
from gridloom.operators.join import join_tables

PART_KEYS = ["l_partkey", "l_suppkey"]


def dup_summary(spark, sf):
    return duplicate_summary(table(spark, sf, "lineitem"), PART_KEYS)


def dup_rows(spark, sf):
    return duplicate_rows(table(spark, sf, "lineitem"), PART_KEYS)


def dup_rows_ordered(spark, sf):
    return duplicate_rows(table(spark, sf, "orders"), ["o_custkey", "o_orderdate"], ordered=True, tie_break="o_orderkey")


def _events_with_gaps(spark, sf):
    """Events whose kind is NULL for errors and spaces for signups."""
    kind = F.when(F.col("event_type") == "signup", "  ").when(F.col("event_type") != "error", F.col("event_type"))
    return table(spark, sf, "events").select("event_id", "user_id", kind.alias("kind"))


def dup_ignore_empty(spark, sf):
    return duplicate_summary(_events_with_gaps(spark, sf), ["user_id", "kind"], ignore_empty=True)


def dup_null_keys(spark, sf):
    return duplicate_summary(_events_with_gaps(spark, sf), ["user_id", "kind"])


def dup_rows_null_keys(spark, sf):
    return duplicate_rows(_events_with_gaps(spark, sf), ["user_id", "kind"])


def dup_rows_ignore_empty(spark, sf):
    return duplicate_rows(_events_with_gaps(spark, sf), ["user_id", "kind"], ignore_empty=True)


_GAPS = """events_with_gaps AS (
    SELECT event_id, user_id,
           CASE WHEN event_type = 'signup' THEN '  ' WHEN event_type <> 'error' THEN event_type END AS kind
    FROM events)"""


def _orders_and_lines(spark, sf):
    return [(table(spark, sf, "orders"), ["o_orderkey"]), (table(spark, sf, "lineitem"), ["l_orderkey"])]


def _cmp(mode):
    def query(spark, sf):
        return compare(_orders_and_lines(spark, sf), mode)
    return query


def cmp_right_only(spark, sf):
    return compare(_orders_and_lines(spark, sf)[::-1], cmp.RIGHT_ONLY)


def cmp_status_counts(spark, sf):
    return status_counts(compare(_orders_and_lines(spark, sf)))


def cmp_customers(spark, sf):
    return compare([(table(spark, sf, "customer"), ["c_custkey"]), (table(spark, sf, "orders"), ["o_custkey"])])


def _parts_three_ways(spark, sf):
    lines = table(spark, sf, "lineitem")
    return [
        (table(spark, sf, "part"), ["p_partkey"]),
        (lines, ["l_partkey"]),
        (lines.where(F.col("l_quantity") > 45), ["l_partkey"]),
    ]


def cmp_three_way(spark, sf):
    return compare(_parts_three_ways(spark, sf))


def cmp_three_way_right_only(spark, sf):
    return compare(_parts_three_ways(spark, sf), cmp.RIGHT_ONLY)


def cmp_three_way_right_rows(spark, sf):
    """Keys of the second table alone, where there are some."""
    lines, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    few = lines.where((F.col("l_quantity") > 49) & (F.col("l_linenumber") == 1))
    return compare([(part.where("p_size > 25"), ["p_partkey"]), (lines, ["l_partkey"]), (few, ["l_partkey"])], cmp.RIGHT_ONLY)


def cmp_two_keys(spark, sf):
    lines = table(spark, sf, "lineitem")
    returned, accepted = lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'")
    return compare([(returned, PART_KEYS), (accepted, PART_KEYS)])


def cmp_null_keys(spark, sf):
    buyer = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("buyer")
    return compare([(table(spark, sf, "orders").select(buyer), ["buyer"]), (table(spark, sf, "customer"), ["c_custkey"])])


def _presence(keys, sources, where="TRUE"):
    """Key presence the plain way: distinct keys of all tables, then one EXISTS per table."""
    names = [k for k in keys]
    union = " UNION ".join(
        f"SELECT {', '.join(f'{c} AS {n}' for c, n in zip(cols, names))} FROM {source}" for source, cols in sources)
    flags = ", ".join(
        f"EXISTS (SELECT 1 FROM {source} s WHERE " + " AND ".join(f"s.{c} = k.{n}" for c, n in zip(cols, names))
        + f") AS in_{i}" for i, (source, cols) in enumerate(sources, 1))
    count = " + ".join(f"in_{i}::INT" for i in range(1, len(sources) + 1))
    listed = ", ".join(f"CASE WHEN in_{i} THEN 'file {i}' END" for i in range(1, len(sources) + 1))
    columns = ", ".join(names + [f"in_{i}" for i in range(1, len(sources) + 1)])
    return f"""WITH flagged AS (SELECT {', '.join('k.' + n for n in names)}, {flags} FROM ({union}) k),
        counted AS (SELECT *, {count} AS n FROM flagged)
        SELECT {columns}, CASE WHEN n = 1 THEN 'Only in: ' || concat_ws(', ', {listed})
            WHEN n = {len(sources)} THEN 'In all files' ELSE 'In files: ' || concat_ws(', ', {listed}) END AS status
        FROM counted WHERE {where}"""


_ORDERS_AND_LINES = (["o_orderkey"], [("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey"])])
_LINES_AND_ORDERS = (["l_orderkey"], [("lineitem", ["l_orderkey"]), ("orders", ["o_orderkey"])])
_THREE_PARTS = (["p_partkey"], [
    ("part", ["p_partkey"]), ("lineitem", ["l_partkey"]),
    ("(SELECT * FROM lineitem WHERE l_quantity > 45)", ["l_partkey"])])


def join_inner(spark, sf):
    return join_tables(
        table(spark, sf, "orders"), table(spark, sf, "customer"), ["o_custkey"], ["c_custkey"],
        left_columns=["o_orderkey", "o_totalprice"], right_columns=["c_name", "c_mktsegment"])


def join_left(spark, sf):
    return join_tables(
        table(spark, sf, "customer"), table(spark, sf, "orders"), ["c_custkey"], ["o_custkey"], "left",
        ["c_custkey", "c_name"], ["o_orderkey", "o_totalprice"])


def join_right(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return join_tables(
        urgent, table(spark, sf, "customer"), ["o_custkey"], ["c_custkey"], "right",
        ["o_orderkey", "o_orderpriority"], ["c_custkey", "c_name"])


def join_null_keys(spark, sf):
    buyer = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("buyer")
    orders = table(spark, sf, "orders").select("o_orderkey", buyer)
    return join_tables(orders, table(spark, sf, "customer"), ["buyer"], ["c_custkey"], "left", right_columns=["c_name"])


def join_rename(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return join_tables(orders, orders, ["o_orderkey"], right_columns=["O_ORDERKEY", "o_orderstatus"])


def join_two_keys(spark, sf):
    lines = table(spark, sf, "lineitem")
    return join_tables(
        lines, duplicate_summary(lines, PART_KEYS, ordered=False), PART_KEYS,
        left_columns=["l_orderkey", "l_linenumber", *PART_KEYS], right_columns=["duplicate_count"])


def join_ordered(spark, sf):
    return join_tables(
        table(spark, sf, "customer"), table(spark, sf, "orders"), ["c_custkey"], ["o_custkey"],
        left_columns=["c_custkey"], right_columns=["o_orderkey"], ordered=True)


def join_all_columns(spark, sf):
    return join_tables(table(spark, sf, "supplier"), table(spark, sf, "nation"), ["s_nationkey"], ["n_nationkey"])


def join_self(spark, sf):
    """The benchmark's shape: a table joined with itself on a key that repeats a few times."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return join_tables(lines, lines, ["l_orderkey"])


QUERIES = {
    "dup_summary": dup_summary,
    "dup_rows": dup_rows,
    "dup_rows_ordered": dup_rows_ordered,
    "dup_ignore_empty": dup_ignore_empty,
    "dup_null_keys": dup_null_keys,
    "dup_rows_null_keys": dup_rows_null_keys,
    "dup_rows_ignore_empty": dup_rows_ignore_empty,
    "cmp_all_status": _cmp(cmp.ALL_WITH_STATUS),
    "cmp_common": _cmp(cmp.COMMON_ROWS),
    "cmp_left_only": _cmp(cmp.LEFT_ONLY),
    "cmp_right_only": cmp_right_only,
    "cmp_different": _cmp(cmp.DIFFERENT_ROWS),
    "cmp_status_counts": cmp_status_counts,
    "cmp_customers": cmp_customers,
    "cmp_three_way": cmp_three_way,
    "cmp_three_way_right_only": cmp_three_way_right_only,
    "cmp_three_way_right_rows": cmp_three_way_right_rows,
    "cmp_two_keys": cmp_two_keys,
    "cmp_null_keys": cmp_null_keys,
    "join_inner": join_inner,
    "join_left": join_left,
    "join_right": join_right,
    "join_null_keys": join_null_keys,
    "join_rename": join_rename,
    "join_two_keys": join_two_keys,
    "join_ordered": join_ordered,
    "join_all_columns": join_all_columns,
    "join_self": join_self,
}

ORACLES = {
    "dup_summary": """SELECT l_partkey, l_suppkey, count(*) AS duplicate_count FROM lineitem
        GROUP BY l_partkey, l_suppkey HAVING count(*) > 1""",
    "dup_rows": """SELECT l.* FROM lineitem l JOIN (SELECT l_partkey, l_suppkey FROM lineitem
        GROUP BY l_partkey, l_suppkey HAVING count(*) > 1) d
        ON l.l_partkey = d.l_partkey AND l.l_suppkey = d.l_suppkey""",
    "dup_rows_ordered": """SELECT o.* FROM orders o JOIN (SELECT o_custkey, o_orderdate FROM orders
        GROUP BY o_custkey, o_orderdate HAVING count(*) > 1) d
        ON o.o_custkey = d.o_custkey AND o.o_orderdate = d.o_orderdate
        ORDER BY o.o_custkey, o.o_orderdate, o.o_orderkey""",
    "dup_ignore_empty": f"""WITH {_GAPS} SELECT user_id, kind, count(*) AS duplicate_count FROM events_with_gaps
        WHERE user_id IS NOT NULL AND nullif(trim(kind), '') IS NOT NULL
        GROUP BY user_id, kind HAVING count(*) > 1""",
    "dup_null_keys": f"""WITH {_GAPS} SELECT user_id, kind, count(*) AS duplicate_count FROM events_with_gaps
        GROUP BY user_id, kind HAVING count(*) > 1""",
    "dup_rows_null_keys": f"""WITH {_GAPS} SELECT e.* FROM events_with_gaps e JOIN (
        SELECT user_id, kind FROM events_with_gaps GROUP BY user_id, kind HAVING count(*) > 1) d
        ON e.user_id = d.user_id AND e.kind = d.kind""",
    "dup_rows_ignore_empty": f"""WITH {_GAPS} SELECT e.* FROM events_with_gaps e JOIN (
        SELECT user_id, kind FROM events_with_gaps WHERE nullif(trim(kind), '') IS NOT NULL
        GROUP BY user_id, kind HAVING count(*) > 1) d ON e.user_id = d.user_id AND e.kind = d.kind""",
    "cmp_all_status": _presence(*_ORDERS_AND_LINES),
    "cmp_common": _presence(*_ORDERS_AND_LINES, "n = 2"),
    "cmp_left_only": _presence(*_ORDERS_AND_LINES, "n = 1 AND in_1"),
    "cmp_right_only": _presence(*_LINES_AND_ORDERS, "n = 1 AND in_2"),
    "cmp_different": _presence(*_ORDERS_AND_LINES, "n < 2"),
    "cmp_status_counts": f"""SELECT status, count(*) AS key_count, CAST(sum(count(*)) OVER () AS BIGINT) AS total_keys
        FROM ({_presence(*_ORDERS_AND_LINES)}) GROUP BY status""",
    "cmp_customers": _presence(["c_custkey"], [("customer", ["c_custkey"]), ("orders", ["o_custkey"])]),
    "cmp_three_way": _presence(*_THREE_PARTS),
    "cmp_three_way_right_only": _presence(*_THREE_PARTS, "n = 1 AND in_2"),
    "cmp_three_way_right_rows": _presence(["p_partkey"], [
        ("(SELECT * FROM part WHERE p_size > 25)", ["p_partkey"]), ("lineitem", ["l_partkey"]),
        ("(SELECT * FROM lineitem WHERE l_quantity > 49 AND l_linenumber = 1)", ["l_partkey"])], "n = 1 AND in_2"),
    "cmp_two_keys": _presence(PART_KEYS, [
        ("(SELECT * FROM lineitem WHERE l_returnflag = 'R')", PART_KEYS),
        ("(SELECT * FROM lineitem WHERE l_returnflag = 'A')", PART_KEYS)]),
    "cmp_null_keys": _presence(["buyer"], [
        ("(SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS buyer FROM orders)", ["buyer"]),
        ("customer", ["c_custkey"])]),
    "join_inner": """SELECT o_orderkey, o_totalprice, c_name, c_mktsegment
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "join_left": """SELECT c_custkey, c_name, o_orderkey, o_totalprice
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey""",
    "join_right": """SELECT o_orderkey, o_orderpriority, c_custkey, c_name
        FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o RIGHT JOIN customer ON o_custkey = c_custkey""",
    "join_null_keys": """SELECT o_orderkey, buyer, c_name FROM (
        SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS buyer FROM orders) o
        LEFT JOIN customer ON buyer = c_custkey""",
    "join_rename": """SELECT a.o_orderkey, a.o_custkey, a.o_orderstatus, b.o_orderkey AS right_o_orderkey,
        b.o_orderstatus AS right_o_orderstatus FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey""",
    "join_two_keys": """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, d.duplicate_count
        FROM lineitem l JOIN (SELECT l_partkey, l_suppkey, count(*) AS duplicate_count FROM lineitem
        GROUP BY l_partkey, l_suppkey HAVING count(*) > 1) d
        ON l.l_partkey = d.l_partkey AND l.l_suppkey = d.l_suppkey""",
    "join_ordered": """SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey
        ORDER BY c_custkey""",
    "join_all_columns": "SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "join_self": """SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, b.l_orderkey AS right_l_orderkey,
        b.l_linenumber AS right_l_linenumber, b.l_partkey AS right_l_partkey
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey""",
}
