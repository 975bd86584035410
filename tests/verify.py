"""Compare queries with their oracle SQL: ``python tests/verify.py [--sf DIR] [NAME...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def rows(names, table) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    norm = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(repr(norm(r[i])) for i in order) for r in table))


def main(args: list[str]) -> int:
    import duckdb

    import __spark_entry__ as e
    from plumage.session import get_spark

    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'" if p.is_file() else f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    bad = 0
    if args[:1] == ["--module"]:
        import importlib

        args = [n for m in args[1:] for n in importlib.import_module(f"plumage.plans.{m}").reg.queries]
    for name in args or list(e.queries()):
        t = time.time()
        try:
            df = e.queries()[name](spark, sf)
            got = rows(df.columns, df.collect())
            took = time.time() - t
            if name not in e.oracle_sql():
                print(f"{name}: {len(got)} rows, no SQL, {took:.1f} s", flush=True)
                continue
            r = con.sql(e.oracle_sql()[name])
            want = rows(r.columns, r.fetchall())
            same = got == want and sorted(df.columns) == sorted(r.columns)
            print(f"{name}: {'ok' if same else 'DIFFERS'} {len(got)} {len(want)}, {took:.1f} s", flush=True)
            if not same:
                bad += 1
                print("  ", sorted(df.columns), sorted(r.columns), [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3])
        except Exception as x:
            bad += 1
            print(f"{name}: FAILED {str(x)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
