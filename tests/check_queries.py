"""Run registered queries beside their SQL in DuckDB: python tests/check_queries.py [sf] [name ...]"""

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import __spark_entry__ as entry  # noqa: E402
from gridloom.cluster import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return repr(value)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def main(sf="0.01", *only):
    folder = f"/root/testdata/sf{sf}"
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    spark = local_session()
    oracles, failed = entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if only and name not in only or name not in oracles:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            got = sorted_rows(df.columns, map(tuple, df.collect()))
            took = time.time() - start
            result = db.execute(oracles[name])
            names = [d[0] for d in result.description]
            want = sorted_rows(names, result.fetchall())
            good = sorted(names) == sorted(df.columns) and got == want
            print(f"{'ok  ' if good else 'BAD '} {name:28} rows={len(got)} {took:.2f}s", flush=True)
            if not good:
                failed.append(name)
                print("   columns", sorted(df.columns), sorted(names), "rows", len(got), len(want))
                for a in [r for r in got if r not in set(want)][:3]:
                    print("   spark ", str(a)[:400])
                for a in [r for r in want if r not in set(got)][:3]:
                    print("   oracle", str(a)[:400])
        except Exception as error:
            failed.append(name)
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
