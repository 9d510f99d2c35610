"""Latest row per unit as a table of small runs.

Units are dealt to hash buckets.  A batch writes its newest row per unit as one
run of each bucket it touches; runs of one size are merged as they gather, so
the bytes written follow the batch (times a logarithm of the table), not the
table.  A manifest per batch names the runs that make up the table.  It is put
in place by a rename, so a batch counts wholly or not at all, a batch tried
again after that changes nothing, and readers see whole batches.  Files that
neither the newest manifest nor the one before names are removed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64

#: bucket -> [(batch, rows)], the oldest run first
Runs = dict[int, list[tuple[int, int]]]


@dataclass
class LatestTable:
    """``newest`` orders the rows of a unit: the largest wins, the later batch among equals."""

    spark: SparkSession
    path: str
    key: str = "unit_id"
    newest: str = "cycle"
    buckets: int = BUCKETS

    # files -------------------------------------------------------------------

    def _at(self, *parts: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        path, fs = self._at("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _runs(self, batch: int) -> Runs:
        path, fs = self._at("manifest", f"{batch:012d}.json")
        stream = fs.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return {int(b): [tuple(r) for r in runs] for b, runs in json.loads(text).items()}

    def _commit(self, batch: int, runs: Runs, schema: T.StructType) -> None:
        path, fs = self._at("schema.json")
        if not fs.exists(path):
            stream = fs.create(path, True)
            stream.write(bytearray(schema.json().encode()))
            stream.close()
        draft, fs = self._at("manifest", f"{batch:012d}.draft")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(runs).encode()))
        stream.close()
        # a rename puts the manifest in place at once
        if not fs.rename(draft, self._at("manifest", f"{batch:012d}.json")[0]):
            raise RuntimeError(f"batch {batch} of {self.path} could not be committed")

    def _folder(self, batch: int, bucket: int) -> str:
        return f"{self.path}/runs/batch={batch}/bucket={bucket}"

    # reading -----------------------------------------------------------------

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The newest row per key of runs with their batch as ``_batch``."""
        others = [c for c in rows.columns if c not in (self.key, "_batch")]
        best = F.max_by(F.struct(*others, "_batch"), F.struct(self.newest, "_batch")).alias("_s")
        return rows.groupBy(self.key).agg(best).select(self.key, "_s.*")

    def _read(self, runs: Runs) -> DataFrame | None:
        by_batch: dict[int, list[int]] = {}
        for bucket, own in runs.items():
            for batch, _ in own:
                by_batch.setdefault(batch, []).append(bucket)
        out = None
        for batch, buckets in sorted(by_batch.items()):
            part = self.spark.read.parquet(*[self._folder(batch, b) for b in sorted(buckets)]).withColumn("_batch", F.lit(batch).cast("long"))
            out = part if out is None else out.unionByName(part)
        return out

    def read(self) -> DataFrame:
        """The newest row per key as of the last whole batch; batches without a row leave an empty table."""
        done = self._manifests()
        if not done:
            raise FileNotFoundError(f"{self.path} has taken no batch")
        path, fs = self._at("schema.json")
        stream = fs.open(path)
        schema = T.StructType.fromJson(json.loads(bytes(stream.readAllBytes()).decode()))
        stream.close()
        rows = self._read(self._runs(done[-1]))
        return self.spark.createDataFrame([], schema) if rows is None else self._newest(rows).select(*schema.names)

    # writing -----------------------------------------------------------------

    def merge(self, batch: DataFrame, batch_id: int) -> int:
        """Take in a batch (its rows of a unit in any order); returns the rows written."""
        done = self._manifests()
        if batch_id in done:
            return 0
        before = [b for b in done if b < batch_id]
        runs = self._runs(before[-1]) if before else {}
        staged = f"{self.path}/staged/{batch_id}"
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        own = self._newest(batch.where(F.col(self.key).isNotNull()).withColumn("_batch", F.lit(batch_id).cast("long")))
        own.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(staged)
        fresh = self.spark.read.schema(own.withColumn("_bucket", bucket).schema).parquet(staged)
        # at most ``buckets`` rows
        sizes = {r["_bucket"]: r["n"] for r in fresh.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        merged: Runs = {}
        for b, size in sizes.items():
            kept = list(runs.get(b, []))
            while kept and kept[-1][1] <= 2 * size:
                size += kept[-1][1]
                merged.setdefault(b, []).append(kept.pop())
            runs[b] = [*kept, (batch_id, size)]
        rows = fresh.drop("_bucket")
        old = self._read(merged)
        if old is not None:
            rows = self._newest(rows.unionByName(old))
        out = rows.drop("_batch").withColumn("bucket", bucket)
        # one file per bucket touched: the merged runs of a bucket are of the batch's own size
        out.repartition(max(1, len(sizes)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/runs/batch={batch_id}")
        self._commit(batch_id, runs, batch.schema)
        self._remove(f"staged/{batch_id}")
        self._clean(runs, self._runs(before[-1]) if before else {}, before)
        return sum(runs[b][-1][1] for b in sizes)

    def _remove(self, name: str) -> None:
        path, fs = self._at(name)
        fs.delete(path, True)

    def _clean(self, runs: Runs, last: Runs, before: list[int]) -> None:
        named = {(batch, b) for known in (runs, last) for b, own in known.items() for batch, _ in own}
        path, fs = self._at("runs")
        for folder in fs.listStatus(path) if fs.exists(path) else []:
            batch = int(folder.getPath().getName().split("=")[1])
            buckets = [s.getPath() for s in fs.listStatus(folder.getPath()) if "=" in s.getPath().getName()]
            stale = [p for p in buckets if (batch, int(p.getName().split("=")[1])) not in named]
            if len(stale) == len(buckets):
                fs.delete(folder.getPath(), True)
            else:
                for p in stale:
                    fs.delete(p, True)
        for old in before[:-1]:
            self._remove(f"manifest/{old:012d}.json")
