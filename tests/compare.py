"""Run queries beside their SQL and compare rows: ``python -m tests.compare [sf_dir] [name...]``."""

import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return round(v, 9) + 0.0
        if isinstance(v, (list, tuple)):
            return tuple(map(plain, v))
        return v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir, name, query, sql):
    """Return None if the rows are equal, else what differs first."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = query(spark, sf_dir)
    want = con.sql(sql)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows_of(got.columns, got.collect()), rows_of(want.columns, want.fetchall())
    if a != b:
        return f"{len(a)} and {len(b)} rows; only here {[x for x in a if x not in set(b)][:3]}; only in SQL {[x for x in b if x not in set(a)][:3]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from colsense.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session("compare")
    for name, sql in entry.oracle_sql().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            said = compare(spark, sf_dir, name, entry.queries()[name], sql)
        except Exception as e:  # shown, and the next one runs
            said = f"{type(e).__name__}: {str(e)[:700]}"
        print(name, f"{time.time() - began:.1f}s", "ok" if said is None else said[:900], flush=True)
