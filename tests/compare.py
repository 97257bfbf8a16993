"""Side-by-side run of registered queries and their SQL; also a script: compare.py DIR [KEY...]."""

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    return "NaN" if isinstance(value, float) and math.isnan(value) else value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None when names and rows agree, else what differs."""
    df = query(spark, sf_dir)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(names, result.fetchall())
    if ours == theirs:
        return None
    only_ours, only_theirs = ours - theirs, theirs - ours
    return (f"{sum(ours.values())} against {sum(theirs.values())} rows; only ours "
            f"{list(only_ours.items())[:2]}; only theirs {list(only_theirs.items())[:2]}")


def main() -> None:
    from conftest import make_session

    import __spark_entry__ as entry

    sf_dir, keys = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    for key in keys or queries:
        start = time.time()
        try:
            found = difference(spark, con, queries[key], sql[key], sf_dir) if key in sql else "no SQL"
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{key:28} {time.time() - start:6.1f}s  {'ok' if found is None else found[:1200]}", flush=True)


if __name__ == "__main__":
    main()
