"""Streaming queries run to completion over stored tables.

The stream reads a table's Parquet files (``readStream``, ``availableNow``),
keeps per-unit contract state and writes its rows to the shared checkpoint
folder and to a latest-status table.  The oracles are batch SQL, so a match
shows stream = batch: over the trajectories, where every row is accepted, and
over the events, where most rows break the contract.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import tables
from ..streaming import units
from ..streaming.latest import LatestTable
from .features import _feature_sql
from .registry import finish, register

SENSORS = ["sensor_1", "sensor_4"]
FEATS = [f"{s}_{x}" for s in SENSORS for x in ["lag_1", "lag_5", "rolling_mean_5", "rolling_std_5", "delta_1"]]
STREAM_SQL = f"""
SELECT unit_id, cycle, 'ok' AS status, {_feature_sql(SENSORS)},
       sensor_4 > 0.06 AS exceeded,
       CAST(sum(CAST(sensor_4 > 0.06 AS INT)) OVER w5 AS BIGINT) AS recent_count,
       count(*) OVER w5 AS recent_size,
       count(*) OVER w5 >= 5 AND sum(CAST(sensor_4 > 0.06 AS INT)) OVER w5 >= 3 AS alert_active
FROM traj
WINDOW o AS (PARTITION BY unit_id ORDER BY cycle),
       w5 AS (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""


_RUNS: dict = {}


def _run(spark, name, version, stream, sensors):
    """Run the contract stream to its end once per session and version of its input.

    One ``foreachBatch`` writes a folder of rows per batch, which a retried
    batch writes again, and takes the batch into the latest-status table.
    """
    key = (spark.sparkContext.applicationId, name, version)
    if key in _RUNS:
        return _RUNS[key]
    run = uuid.uuid4().hex
    out = units.contract_stream(stream, sensors)
    rows_path = scratch_path(spark, f"stream-rows-{run}")
    table = LatestTable(spark, scratch_path(spark, f"stream-latest-{run}"))

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{rows_path}/batch={batch_id}")
        written = batch.sparkSession.read.schema(batch.schema).parquet(f"{rows_path}/batch={batch_id}")
        table.merge(written.where("status = 'ok'"), batch_id)

    # state partitions are fixed when a query first starts: size them to the
    # cluster's cores rather than a batch-oriented shuffle setting
    previous = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(max(1, spark.sparkContext.defaultParallelism)))
    try:
        q = (out.writeStream.foreachBatch(sink)
             .option("checkpointLocation", scratch_path(spark, f"stream-ckpt-{run}"))
             .trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", previous)
    q.awaitTermination()
    # a table without rows makes no batch
    rows = spark.read.parquet(rows_path).drop("batch") if q.lastProgress else spark.createDataFrame([], out.schema)
    _RUNS[key] = (rows, table.read() if q.lastProgress else rows)
    return _RUNS[key]


def _trajectories(spark, sf_dir):
    """The stored trajectory table as a stream."""
    stored = tables.traj(spark, sf_dir).select("unit_id", "cycle", *SENSORS)
    files = stored.inputFiles()
    stream = spark.readStream.schema(tables.traj(spark, sf_dir).schema).parquet(os.path.dirname(files[0]))
    stream = stream.select("unit_id", "cycle", *SENSORS, (F.col("sensor_4") > 0.06).alias("exceeded"), F.col("cycle").alias("arrival"))
    return _run(spark, "traj", os.path.dirname(files[0]), stream, SENSORS)


@register("stream_unit_state", ops=["W2", "W3", "G2", "G3", "G4", "G5", "G6", "G8"], views=["traj"],
          round_cols=FEATS, sql=STREAM_SQL)
def stream_unit_state(spark, sf_dir):
    """Per-unit stateful stream (ring buffer of 6 rows): temporal features,
    3-of-5 persistence and contract status for every arriving row."""
    rows, _ = _trajectories(spark, sf_dir)
    return finish(rows)


@register("stream_latest_status", ops=["W5", "G11"], views=["traj"], round_cols=FEATS, sql=f"""
WITH f AS ({STREAM_SQL}), l AS (SELECT unit_id, max(cycle) AS m FROM traj GROUP BY unit_id)
SELECT f.* FROM f JOIN l ON f.unit_id = l.unit_id AND f.cycle = l.m""")
def stream_latest_status(spark, sf_dir):
    """The same stream's latest-status table (newest cycle per unit wins)."""
    _, latest = _trajectories(spark, sf_dir)
    return finish(latest)


# Events as observations: a user is a unit, the remainder of ``props.k`` its
# cycle, so that cycles repeat, fall and skip; some values are missing.
EVENT_SENSORS = ["value"]
EVENT_FEATURES = [f"value_{x}" for x in ["lag_1", "lag_5", "rolling_mean_5", "rolling_std_5", "delta_1"]]


def _events(spark, sf_dir):
    path = os.path.join(sf_dir, "events.parquet")
    # a pattern, because a stream takes a single file only by one
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(os.path.join(sf_dir, "event[s].parquet"))
    k = F.get_json_object("props", "$.k").try_cast("long")
    stream = stream.where("user_id IS NOT NULL").select(
        F.col("user_id").alias("unit_id"), (k % 12).alias("cycle"), F.col("event_id").alias("arrival"),
        F.when(F.col("event_id") % 53 != 0, F.col("value")).alias("value")).withColumn("exceeded", F.col("value") > 20)
    return _run(spark, path, tables.version(spark, sf_dir, ["events"]), stream, EVENT_SENSORS)


EVENT_SQL = f"""
RECURSIVE ev AS (
  SELECT user_id AS unit_id, event_id AS arrival, CAST(json_extract(props, '$.k') AS BIGINT) % 12 AS cycle,
         CASE WHEN event_id % 53 <> 0 THEN value END AS value FROM events),
acc AS (
  SELECT * FROM (SELECT unit_id, arrival, cycle, value, row_number() OVER (PARTITION BY unit_id ORDER BY arrival) AS r
                 FROM ev WHERE cycle > 0 AND value IS NOT NULL) WHERE r = 1
  UNION ALL
  SELECT * FROM (SELECT e.unit_id, e.arrival, e.cycle, e.value, row_number() OVER (PARTITION BY e.unit_id ORDER BY e.arrival) AS r
                 FROM acc a JOIN ev e ON e.unit_id = a.unit_id AND e.cycle = a.cycle + 1 AND e.arrival > a.arrival AND e.value IS NOT NULL)
  WHERE r = 1),
feat AS (
  SELECT unit_id, arrival, cycle, {_feature_sql(EVENT_SENSORS)}, value > 20 AS exceeded,
         CAST(sum(CAST(value > 20 AS INT)) OVER w5 AS BIGINT) AS recent_count, count(*) OVER w5 AS recent_size,
         count(*) OVER w5 >= 5 AND sum(CAST(value > 20 AS INT)) OVER w5 >= 3 AS alert_active
  FROM acc WINDOW o AS (PARTITION BY unit_id ORDER BY cycle),
       w5 AS (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
seen AS (
  SELECT e.unit_id, e.arrival, min(a.cycle) AS first, max(a.cycle) AS last
  FROM ev e LEFT JOIN acc a ON a.unit_id = e.unit_id AND a.arrival < e.arrival GROUP BY e.unit_id, e.arrival),
judged AS (
  SELECT e.unit_id, e.cycle, CASE WHEN f.cycle IS NOT NULL THEN 'ok' WHEN e.value IS NULL THEN 'non_numeric'
           WHEN s.last IS NULL THEN 'non_positive' WHEN e.cycle > s.last THEN 'gap'
           WHEN e.cycle >= s.first THEN 'duplicate' ELSE 'out_of_order' END AS status,
         {", ".join(f"f.{c}" for c in EVENT_FEATURES)}, f.exceeded, f.recent_count, f.recent_size, f.alert_active
  FROM ev e JOIN seen s ON s.unit_id = e.unit_id AND s.arrival = e.arrival
  LEFT JOIN feat f ON f.unit_id = e.unit_id AND f.arrival = e.arrival)
"""


@register("stream_contract_status", ops=["W2", "W3", "W4"], round_cols=EVENT_FEATURES, sql=f"WITH {EVENT_SQL} SELECT * FROM judged")
def stream_contract_status(spark, sf_dir):
    """Contract status of every event as it arrives: accepted, or rejected as
    duplicate, out of order, gap, not positive or not numeric; features and
    alert of the accepted ones."""
    rows, _ = _events(spark, sf_dir)
    return finish(rows)


@register("stream_contract_latest", ops=["W5"], round_cols=EVENT_FEATURES, sql=f"""
WITH {EVENT_SQL} SELECT * FROM judged WHERE status = 'ok' QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY cycle DESC) = 1""")
def stream_contract_latest(spark, sf_dir):
    """Latest accepted status per unit of the event stream."""
    _, latest = _events(spark, sf_dir)
    return finish(latest)
