"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

    python tools/oracle_check.py [sf_dir] [name ...]

Compares row count, column names and order-insensitive values (doubles to
6 digits), like the correctness gate.  Prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from wearline.plans import REGISTRY  # noqa: E402
from wearline.session import get_session  # noqa: E402
from wearline.sources.tables import TABLES  # noqa: E402


STRICT = os.environ.get("STRICT") == "1"


def norm(v):
    if v is None:
        return ("~",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("f", v if STRICT else round(v, 5))
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return ("l", tuple(norm(x) for x in v))
    return ("v", str(v))


def rows_of(records, cols):
    return sorted(tuple(norm(r[c]) for c in cols) for r in records)


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if a in REGISTRY] or list(REGISTRY)
    extra = {}
    spark = get_session("local[8]", **extra)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in names:
        q = REGISTRY[name]
        t0 = time.time()
        try:
            sdf = q.build(spark, sf_dir)
            srows = [r.asDict() for r in sdf.collect()]
            scols = sorted(sdf.columns)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if not q.sql:
            print(f"rows {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(q.sql)
            dcols = [d[0] for d in res.description]
            drows = [dict(zip(dcols, r)) for r in res.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:300]}")
            bad += 1
            continue
        dtypes = {d[0]: str(d[1]).upper() for d in res.description}
        stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
        want = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT"}
        tbad = [(c, stypes.get(c), dtypes.get(c)) for c in scols
                if c in dtypes and want.get(stypes.get(c), stypes.get(c)) != dtypes.get(c)]
        if tbad:
            print(f"TYPE {name}: {tbad}")
        if sorted(dcols) != scols:
            print(f"FAIL {name}: columns spark={scols} duck={sorted(dcols)}")
            bad += 1
            continue
        a, b = rows_of(srows, scols), rows_of(drows, scols)
        if len(a) != len(b):
            print(f"FAIL {name}: rows spark={len(a)} duck={len(b)}")
            bad += 1
            continue
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
            print(f"FAIL {name}: values differ, e.g. {diff}")
            bad += 1
            continue
        print(f"ok   {name}: {len(a)} rows {ts:.1f}s")
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()


if __name__ == "__main__":
    main()
