"""Registered queries side by side with their DuckDB SQL.

``python tests/compare.py [sf] [name ...]`` runs them and prints what differs.
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duckdb_rows(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    return sorted(names), _counted(names, result.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    return sorted(df.columns), _counted(df.columns, df.collect())


def _counted(names: list[str], rows) -> Counter:
    order = [names.index(name) for name in sorted(names)]
    return Counter(tuple(row[i] for i in order) for row in rows)


def main(sf: str, wanted: list[str]) -> int:
    import __spark_entry__ as driver
    from txsieve.session import build_session

    spark = build_session("compare", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, oracles, failed = f"/root/testdata/sf{sf}", driver.oracle_sql(), 0
    for name, query in driver.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            columns, rows = spark_rows(query(spark, sf_dir))
            took = time.time() - start
            if name not in oracles:
                outcome = "rows only"
            else:
                expected_columns, expected = duckdb_rows(sf_dir, oracles[name])
                same = columns == expected_columns and rows == expected
                extra, missing = (rows - expected).most_common(2), (expected - rows).most_common(2)
                outcome = "ok" if same else f"DIFFERS extra {extra} missing {missing}"
            failed += outcome.startswith("DIFFERS")
        except Exception as e:
            took, rows, failed = time.time() - start, Counter(), failed + 1
            outcome = f"FAILS {type(e).__name__}: {str(e)[:1500]}"
        print(f"RESULT {name:22} {took:6.2f}s {sum(rows.values()):7} {outcome}", flush=True)
    print(f"RESULT {failed} failed", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1] if len(sys.argv) > 1 else "0.01", sys.argv[2:]) else 0)
