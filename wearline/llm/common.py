"""Shared helpers of the training-data operators.

Rows are identified by a 128-bit hash of (id, text): rows repeated with the
same id and the same text are one document and get one verdict, and a null id
is a value like any other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.session import scratch_path

_WRITTEN: list[str] = []
#: With it, the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a read, not a recomputation.  What
    the write shuffled is of no more use and goes with its end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def note_written(path: str) -> None:
    _WRITTEN.append(path)


def drop_stored(spark: SparkSession) -> None:
    """Remove the intermediates written so far (their results must be written)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def row_key(*cols: Column | str) -> list[Column]:
    """Two independent 64-bit hashes of the columns, as ``_k1`` and ``_k2``."""
    return [
        F.xxhash64(*cols).alias("_k1"),
        F.xxhash64(F.lit("second"), *reversed(cols)).alias("_k2"),
    ]


def numbered(df: DataFrame, group: str, name: str, buckets: int = 64) -> DataFrame:
    """Number the rows of every group from 0 without a gap, as ``name``.

    A group may hold any share of the rows: it is numbered per (group, bucket)
    and shifted by the counts of the group's earlier buckets.  ``_bucket`` must
    be a function of the row that deals a group evenly over 0..buckets-1; rows
    equal in ``_order`` too may swap numbers.
    """
    from pyspark.sql import Window

    sizes = df.groupBy(F.col(group).alias("_g"), F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_g", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_from"))
    own = Window.partitionBy(group, "_bucket").orderBy(*[c for c in ("_order", "_order2") if c in df.columns])
    ranked = df.withColumn("_rank", F.row_number().over(own) - 1)
    out = ranked.join(starts, (F.col(group) == F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    return out.withColumn(name, F.col("_rank") + F.col("_from")).drop("_g", "_b", "_from", "_rank")


def by_place(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns ``_c0``, ``_c1`` ... by place, and the new names of ``wanted``.

    Names that differ only in case, or repeat those an operator uses, cannot
    clash; ``toDF(*docs.columns)`` gives the names back.
    """
    names = docs.columns
    return docs.toDF(*[f"_c{i}" for i in range(len(names))]), [f"_c{names.index(w)}" for w in wanted]
