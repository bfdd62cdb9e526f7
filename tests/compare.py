"""Runs registered queries next to their SQL and reports differences.

Usage: python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import collections
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def database(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs between the Spark result and the SQL result; empty when they are equal."""
    relation = con.execute(sql)
    sql_types = {d[0]: str(d[1]) for d in relation.description}
    sql_rows = relation.fetchall()
    spark_types = {name: TYPES.get(t, t) for name, t in spark_df.dtypes}
    out = []
    if set(spark_types) != set(sql_types):
        return [f"columns: only Spark {sorted(set(spark_types) - set(sql_types))}, only SQL {sorted(set(sql_types) - set(spark_types))}"]
    for name in spark_types:
        if spark_types[name] != sql_types[name]:
            out.append(f"type of {name}: {spark_types[name]} / {sql_types[name]}")
    order = sorted(spark_types)
    place = {name: i for i, name in enumerate(sql_types)}
    left = collections.Counter(tuple(r[c] for c in order) for r in spark_df.collect())
    right = collections.Counter(tuple(r[place[c]] for c in order) for r in sql_rows)
    if left.total() != right.total():
        out.append(f"rows: {left.total()} / {right.total()}")
    if left != right:
        only_left, only_right = left - right, right - left
        out.append(f"values: {only_left.total()} rows only in Spark, {only_right.total()} only in SQL; columns {order}")
        out += [f"  Spark {r}" for r in sorted(only_left, key=repr)[:3]] + [f"  SQL   {r}" for r in sorted(only_right, key=repr)[:3]]
    return out


def main() -> None:
    from spendlens.plans import oracle, queries
    from spendlens.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, statements = local_session(), database(sf_dir), oracle.statements()
    bad = 0
    for name in sys.argv[2:] or queries.QUERIES:
        start = time.time()
        try:
            found = differences(queries.run(name, spark, sf_dir), con, statements[name]) if name in statements else ["no SQL"]
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:700]}"]
        bad += bool(found)
        print(f"{name:28s} {'DIFFERS' if found else 'equal':8s}{time.time() - start:6.1f}s", flush=True)
        for line in found:
            print("    " + line[:900], flush=True)
    print(f"{bad} queries differ")


if __name__ == "__main__":
    main()
