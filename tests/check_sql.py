"""Run registered queries beside their SQL: ``python tests/check_sql.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def _key(row) -> tuple:
    return tuple((v is None, type(v).__name__, str(v)) for v in row)


def compare(db, sql: str, df) -> str | None:
    """None when both sides hold the same rows, else what differs."""
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(_key([r[i] for i in order]) for r in cursor.fetchall())
    columns = sorted(df.columns)
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    got = sorted(_key([r[c] for c in columns]) for r in df.collect())
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"row {[v[1:] for v in g]} against {[v[1:] for v in w]}"[:900]
    return None if got else "no rows"


def main() -> int:
    from newsfacts.catalog.registry import ORACLE, QUERIES
    from newsfacts.session import get_spark

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = args or list(QUERIES)
    spark = get_spark(master="local[8]")
    db = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLE:
                problem = compare(db, ORACLE[name], df)
            else:
                problem = None if df.collect() else "no rows"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:1200]}"
        bad += problem is not None
        kind = "sql" if name in ORACLE else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind:4} {name:32} {time.time()-start:6.2f}s "
              f"{problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
