"""What a stored intermediate leaves on disk."""

from pathlib import Path

from wearline.llm.common import store


def test_stored_intermediates_leave_no_shuffle_files(spark):
    local = [Path(x) for x in [f.toString() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]]
    files = lambda: {p for d in local for p in d.rglob("shuffle_*")}
    spark._jvm.System.gc()
    before = files()
    out = store(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "no-shuffle-left")
    assert not files() - before
    assert out.count() == 7
