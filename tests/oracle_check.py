"""Compare registered queries with their SQL twins: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(d: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for n in TABLES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{d}/{n}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)) if v is None else "", str(v)) for v in row)


def compare(df, con, sql: str) -> str | None:
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    got = [r.asDict() for r in df.collect()]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    cols = sorted(names)
    a = sorted(([r[c] for c in cols] for r in got), key=_key)
    b = sorted(([r[c] for c in cols] for r in want), key=_key)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if any(
        type(u) is not type(v) or (u != v and not (isinstance(u, float) and math.isnan(u) and math.isnan(v)))
        or (isinstance(u, float) and u == 0 and math.copysign(1, u) != math.copysign(1, v))
        for u, v in zip(x, y))]
    return f"{len(bad)}/{len(a)} rows differ, first {bad[0]} ({cols})" if bad else None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    d = f"/root/testdata/sf{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, oracles = duck(d), entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(qs)
    failed = 0
    for n in names:
        start = time.time()
        try:
            if n in oracles:
                note = compare(qs[n](spark, d), con, oracles[n]) or "ok"
            else:
                note = f"ok (rows only: {qs[n](spark, d).count()})"
        except Exception as e:  # noqa: BLE001
            note = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        failed += not note.startswith("ok")
        print(f"{time.time() - start:6.1f}s {n:32s} {note}", flush=True)
    print(f"{len(names) - failed} of {len(names)} fine")
    return failed


if __name__ == "__main__":
    sys.exit(main())
