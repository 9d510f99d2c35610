"""Benchmark: wall time of every registered query on one scale factor.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs to completion through Spark's ``noop`` sink (full execution,
nothing collected to the driver).  The fixture views are built once first
and timed separately as ``views``.  Queries that fit MLlib models (GBT / RF
training, minutes at sf0.1) are listed under ``excluded_model_training``
unless ``BENCH_INCLUDE_TRAINING=1``.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wearline.plans import REGISTRY  # noqa: E402
from wearline.session import get_session  # noqa: E402
from wearline.sources import tables  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:] if a in REGISTRY]
    scratch = tempfile.mkdtemp(prefix="wearline-bench-")
    spark = get_session(
        f"local[{cpus}]",
        **{
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
            "spark.sql.shuffle.partitions": str(max(8, 2 * int(cpus))),
            "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
            "spark.local.dir": os.path.join(scratch, "local"),
        },
    )
    timings: dict[str, float] = {}
    t0 = time.time()
    tables.traj(spark, sf_dir).write.format("noop").mode("overwrite").save()
    tables.vecs(spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings["views"] = round(time.time() - t0, 3)
    failed = []
    with_training = os.environ.get("BENCH_INCLUDE_TRAINING") == "1"
    excluded = []
    for name, q in REGISTRY.items():
        if only and name not in only:
            continue
        if q.trains and not with_training and not only:
            excluded.append(name)
            continue
        t = time.time()
        try:
            q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.time() - t, 3)
        except Exception as e:  # noqa: BLE001
            failed.append(name)
            print(f"# {name} failed: {str(e)[:200]}", file=sys.stderr)
    total = round(sum(timings.values()), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({
        "metric": "total_wall_time_all_queries",
        "value": total,
        "unit": "sec",
        "queries": timings,
        "failed": failed,
        "excluded_model_training": excluded,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
