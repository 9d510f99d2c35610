"""Strict ingest: JSON requests (S8, V3) made from ``events``, CSV files (S7) of the fleet.

A request holds the events of one user in a block of 500 event ids, at most
500 observations.  Every kind of fault is seeded by a rule on the ids; the
bodies are text, so that the readers see what a client sends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import columns as X
from ..operators import validate, windows
from ..session import materialize, scratch_path
from ..sources import readers, requests, tables
from .features import _feature_sql
from .registry import finish, register

BLOCK = 500
_OTHERS = [c for c in requests.RUL_REQUEST.names if c != "cycle"]
#: Fault of an observation by event_id mod 101: the field it changes and the JSON put there.
_BAD_VALUES = {
    1: ("sensor_2", '"12.5"'), 2: ("sensor_3", "true"), 3: ("sensor_4", "null"), 6: ("cycle", "1.5"), 7: ("cycle", "0"),
    8: ("cycle", "true"), 9: ("sensor_8", "1e999"), 10: ("sensor_9", "{}"), 11: ("sensor_11", "[]"), 13: ("cycle", "-1"),
    14: ("cycle", '"3"'),
}
_ABSENT, _EXTRA, _NO_OBJECT = 4, 5, 12
#: Fault of a request by (7 user_id + block) mod 37: unit_id as JSON.
_UNITS = {4: "true", 8: "1.5", 10: "null", 11: '"engine 7"', 12: "{}"}


def _observation_sql(concat_value: str) -> str:
    """CASE text of one observation, in SQL that Spark and DuckDB both run."""
    def value(name: str, good: str) -> str:
        arms = " ".join(f"WHEN {k} THEN '{text}'" for k, (field, text) in _BAD_VALUES.items() if field == name)
        return f"CASE event_id % 101 {arms} ELSE {good} END" if arms else good

    parts = [f"'\"cycle\": ' || {value('cycle', 'CAST(seq AS VARCHAR(20))')}"]
    for i, name in enumerate(_OTHERS):
        good = concat_value.format(i=i)
        part = f"', \"{name}\": ' || {value(name, good)}"
        parts.append(f"CASE WHEN event_id % 101 = {_ABSENT} THEN '' ELSE {part} END" if name == "sensor_7" else part)
    parts.append(f"CASE WHEN event_id % 101 = {_EXTRA} THEN ', \"rul\": 3' ELSE '' END")
    return f"CASE WHEN event_id % 101 = {_NO_OBJECT} THEN '7' ELSE '{{' || {' || '.join(parts)} || '}}' END"


_VALUE = "CAST(CAST(value AS DECIMAL(18,2)) + {i} AS VARCHAR(40))"


def _body_sql() -> str:
    units = " ".join(f"WHEN {k} THEN '{text}'" for k, text in _UNITS.items())
    body = (f"'{{\"unit_id\": ' || CASE mark {units} ELSE CAST(user_id AS VARCHAR(20)) END || "
            "CASE mark WHEN 2 THEN ', \"observations\": []' WHEN 3 THEN ', \"observations\": {}' WHEN 13 THEN ', \"observations\": 5' "
            "WHEN 6 THEN '' ELSE ', \"observations\": [' || items || ']' END || "
            "CASE WHEN mark = 5 THEN ', \"Machine failure\": 1' ELSE '' END || '}'")
    return (f"CASE mark WHEN 1 THEN substr({body}, 1, length({body}) - 1) WHEN 7 THEN '[' || {body} || ']' "
            f"WHEN 9 THEN {body} || ' x' WHEN 14 THEN '' ELSE {body} END")


def trajectory_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, body): JSON requests of the events of each (user, block of event ids)."""
    events = tables.table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.expr(f"event_id DIV {BLOCK}").alias("block"))
    own = Window.partitionBy("user_id", "block").orderBy("event_id")
    items = events.withColumn("seq", F.row_number().over(own)).withColumn("item", F.expr(_observation_sql(_VALUE)))
    # at most BLOCK items a request: event_id is unique
    whole = items.groupBy("user_id", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "item"))), lambda x: x["item"]), ", ").alias("items"))
    whole = whole.withColumn("mark", F.expr("(7 * user_id + block) % 37"))
    return whole.select(F.concat_ws(":", "user_id", "block").alias("request_id"), F.expr(_body_sql()).alias("body"))


_REQUESTS = f"""r0 AS (
  SELECT event_id, user_id, value, event_id // {BLOCK} AS block,
         row_number() OVER (PARTITION BY user_id, event_id // {BLOCK} ORDER BY event_id) AS seq FROM events),
r1 AS (SELECT user_id, block, seq, {_observation_sql(_VALUE)} AS item FROM r0),
r2 AS (SELECT user_id, block, string_agg(item, ', ' ORDER BY seq) AS items, (7 * user_id + block) % 37 AS mark
       FROM r1 GROUP BY user_id, block),
req AS (SELECT user_id || ':' || block AS request_id, {_body_sql()} AS body FROM r2),
top AS (SELECT request_id, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM req),
ob AS (
  SELECT request_id, generate_subscripts(list, 1) - 1 AS i, unnest(list) AS o
  FROM (SELECT request_id, CASE WHEN json_type(j, '$.observations') = 'ARRAY' THEN json_extract(j, '$.observations[*]') END AS list FROM top)),
"""


def _type_reason(kind: str, choice: bool = False) -> str:
    return (f"WHEN {kind} = 'NULL' THEN 'null' WHEN {kind} = 'BOOLEAN' THEN 'boolean' WHEN {kind} = 'OBJECT' THEN 'object' "
            f"WHEN {kind} = 'ARRAY' THEN 'array' WHEN {kind} {'<>' if choice else '='} 'VARCHAR' THEN '{'number' if choice else 'text'}'")


def _field_rows(names) -> str:
    return ", ".join(f"('{n}')" for n in names)


_FAULTS = _REQUESTS + f"""field(name) AS (VALUES {_field_rows(requests.RUL_REQUEST.names)}),
typed AS (
  SELECT request_id, i, name, json_type(o, '$.' || name) AS t, TRY_CAST(json_extract_string(o, '$.' || name) AS DOUBLE) AS v
  FROM ob, field WHERE json_type(o) = 'OBJECT'),
fault AS (
  SELECT request_id, '' AS place, '' AS field, CASE WHEN j IS NULL THEN 'malformed' ELSE 'not an object' END AS reason
  FROM top WHERE j IS NULL OR json_type(j) <> 'OBJECT'
  UNION ALL
  SELECT request_id, '', 'unit_id', CASE {_type_reason("json_type(j, '$.unit_id')", choice=True)} END FROM top
  WHERE json_type(j, '$.unit_id') NOT IN ('NULL', 'VARCHAR', 'UBIGINT', 'BIGINT')
  UNION ALL
  SELECT request_id, '', 'observations', CASE WHEN json_type(j, '$.observations') IS NULL THEN 'missing'
    WHEN json_type(j, '$.observations') = 'ARRAY' THEN 'empty' {_type_reason("json_type(j, '$.observations')")} ELSE 'number' END
  FROM top WHERE json_type(j) = 'OBJECT' AND coalesce(json_type(j, '$.observations') <> 'ARRAY' OR json_array_length(j, '$.observations') = 0, true)
  UNION ALL
  SELECT request_id, '', k, 'unknown' FROM (SELECT request_id, unnest(json_keys(j)) AS k FROM top WHERE json_type(j) = 'OBJECT')
  WHERE k NOT IN ('unit_id', 'observations')
  UNION ALL
  SELECT request_id, 'observations[' || i || ']', '', 'not an object' FROM ob WHERE json_type(o) <> 'OBJECT'
  UNION ALL
  SELECT request_id, 'observations[' || i || ']', k, 'unknown' FROM (SELECT request_id, i, unnest(json_keys(o)) AS k FROM ob WHERE json_type(o) = 'OBJECT')
  WHERE k NOT IN (SELECT name FROM field)
  UNION ALL
  SELECT * FROM (
    SELECT request_id, 'observations[' || i || ']', name, CASE WHEN t IS NULL THEN 'missing' {_type_reason('t')}
      WHEN name = 'cycle' AND t NOT IN ('UBIGINT', 'BIGINT') THEN 'not an integer' WHEN v IS NULL OR NOT isfinite(v) THEN 'not finite'
      WHEN name = 'cycle' AND v <= 0 THEN 'too small' END AS reason FROM typed) WHERE reason IS NOT NULL)
"""


@register("request_rejections", ops=["S8", "V3", "V2", "V7"], sql=f"WITH {_FAULTS} SELECT request_id, place, field, reason FROM fault")
def request_rejections(spark, sf_dir):
    """Every fault of every trajectory request: place, field and reason, by the JSON type found."""
    checked = requests.checked_requests(trajectory_requests(spark, sf_dir), requests.RUL_REQUEST)
    return requests.rejections(checked)


_ROW_VALUES = ", ".join(
    [f"CAST(json_extract_string(o, '$.{c}') AS BIGINT) AS {c}" if c == "cycle" else f"CAST(json_extract_string(o, '$.{c}') AS DOUBLE) AS {c}"
     for c in requests.RUL_REQUEST.names])


@register("request_rows", ops=["S8", "V3", "V6"], round_cols=_OTHERS, sql=f"""
WITH {_FAULTS}
SELECT request_id, json_extract_string(j, '$.unit_id') AS unit_id, CAST(i AS INT) AS arrival, {_ROW_VALUES}
FROM ob JOIN top USING (request_id) WHERE request_id NOT IN (SELECT request_id FROM fault)""")
def request_rows(spark, sf_dir):
    """Typed observations of the trajectory requests without a fault."""
    checked = requests.checked_requests(trajectory_requests(spark, sf_dir), requests.RUL_REQUEST)
    return finish(requests.accepted_rows(checked, requests.RUL_REQUEST))


_TEMPORAL = [f"{s}_{x}" for s in C.TEMPORAL_BASE_SENSORS for x in C.TEMPORAL_SUFFIXES]


@register("rul_request_predictors", ops=["M27", "S6", "G2", "G3", "G4", "G5", "G6", "G11", "P18"],
          round_cols=[c for c in C.RUL_PREDICTORS if c != "cycle"], sql=f"""
WITH {_FAULTS},
good AS (SELECT request_id, {_ROW_VALUES} FROM ob JOIN top USING (request_id) WHERE request_id NOT IN (SELECT request_id FROM fault)),
feat AS (
  SELECT *, {_feature_sql(C.TEMPORAL_BASE_SENSORS)}, count(*) OVER (PARTITION BY request_id) AS history_cycle_count,
         max(cycle) OVER (PARTITION BY request_id) AS last
  FROM good WINDOW o AS (PARTITION BY request_id ORDER BY cycle),
    w5 AS (PARTITION BY request_id ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT request_id, {", ".join(C.RUL_PREDICTORS)}, history_cycle_count,
       CASE WHEN history_cycle_count >= 6 THEN 'full_context' ELSE 'limited_history' END AS history_quality
FROM feat WHERE cycle = last""")
def rul_request_predictors(spark, sf_dir):
    """The 47 predictors of the newest cycle of every faultless request whose
    trajectory breaks no rule."""
    form = requests.RUL_REQUEST
    rows = requests.accepted_rows(requests.checked_requests(trajectory_requests(spark, sf_dir), form), form).drop("unit_id")
    rows = materialize(rows.withColumnRenamed("request_id", "unit_id"), "request-rows")
    good = validate.valid_trajectories(rows, "unit_id", "cycle", "arrival", form.names)
    feats = windows.add_temporal_features(good, C.TEMPORAL_BASE_SENSORS)
    last = good.groupBy("unit_id").agg(F.max("cycle").alias("_last"), F.count(F.lit(1)).alias("history_cycle_count"))
    newest = feats.join(last, "unit_id").where(F.col("cycle") == F.col("_last"))
    return finish(newest.select(F.col("unit_id").alias("request_id"), *C.RUL_PREDICTORS, "history_cycle_count",
                                X.history_quality("history_cycle_count").alias("history_quality")))


_MACHINE = [f.name for f in requests.FAILURE_REQUEST.fields]
_MACHINE_BAD = {1: ("type", '"X"'), 2: ("type", "3"), 3: ("torque", "-0.5"), 4: ("tool_wear", '"9"'), 5: ("air_temperature", "0"),
                6: ("rotational_speed", "false"), 7: ("process_temperature", "null"), 8: ("torque", "-1e999")}


def _machine_body_sql() -> str:
    good = {
        "type": "'\"' || CASE user_id % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'M' ELSE 'H' END || '\"'",
        **{c: _VALUE.format(i=10 * i) for i, c in enumerate(_MACHINE) if c != "type"}}
    parts = []
    for i, name in enumerate(_MACHINE):
        arms = " ".join(f"WHEN {k} THEN '{text}'" for k, (field, text) in _MACHINE_BAD.items() if field == name)
        value = f"CASE event_id % 29 {arms} ELSE {good[name]} END" if arms else good[name]
        parts.append(f"'{', ' if i else ''}\"{name}\": ' || {value}")
    body = f"'{{' || {' || '.join(parts)} || CASE event_id % 29 WHEN 9 THEN ', \"TWF\": 1' ELSE '' END || '}}'"
    return f"CASE event_id % 29 WHEN 10 THEN '[' || {body} || ']' WHEN 11 THEN substr({body}, 2, 1000) ELSE {body} END"


_MACHINE_FAULTS = f"""WITH req AS (SELECT event_id, {_machine_body_sql()} AS body FROM events),
top AS (SELECT event_id, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM req),
field(name) AS (VALUES {_field_rows(_MACHINE)}),
typed AS (SELECT event_id, name, json_type(j, '$.' || name) AS t, json_extract_string(j, '$.' || name) AS s,
                 TRY_CAST(json_extract_string(j, '$.' || name) AS DOUBLE) AS v FROM top, field WHERE json_type(j) = 'OBJECT'),
fault AS (
  SELECT event_id, '' AS field, CASE WHEN j IS NULL THEN 'malformed' ELSE 'not an object' END AS reason
  FROM top WHERE j IS NULL OR json_type(j) <> 'OBJECT'
  UNION ALL
  SELECT event_id, k, 'unknown' FROM (SELECT event_id, unnest(json_keys(j)) AS k FROM top WHERE json_type(j) = 'OBJECT')
  WHERE k NOT IN (SELECT name FROM field)
  UNION ALL
  SELECT * FROM (
    SELECT event_id, name, CASE WHEN t IS NULL THEN 'missing' WHEN name = 'type' THEN CASE {_type_reason('t', choice=True)}
        WHEN s NOT IN ('L', 'M', 'H') THEN 'not a choice' END
      {_type_reason('t')} WHEN v IS NULL OR NOT isfinite(v) THEN 'not finite'
      WHEN name IN ('torque', 'tool_wear') AND v < 0 THEN 'too small'
      WHEN name NOT IN ('torque', 'tool_wear') AND v <= 0 THEN 'too small' END AS reason FROM typed) WHERE reason IS NOT NULL)
"""


@register("machine_request_verdicts", ops=["S8", "V3", "V11", "V12"], sql=f"""{_MACHINE_FAULTS}
SELECT reason, field, count(*) AS faults, min(event_id) AS first_event FROM fault GROUP BY reason, field
UNION ALL SELECT 'accepted', s, count(*), min(event_id) FROM typed
WHERE name = 'type' AND event_id NOT IN (SELECT event_id FROM fault) GROUP BY s""")
def machine_request_verdicts(spark, sf_dir):
    """Machine requests, one per event: faults by reason and field, and the accepted ones by machine type."""
    events = tables.table(spark, sf_dir, "events").select("event_id", F.expr(_machine_body_sql()).alias("body"))
    good, bad = requests.read_requests(events, requests.FAILURE_REQUEST, key="event_id")
    size, first = F.count(F.lit(1)).alias("faults"), F.min("event_id").alias("first_event")
    return bad.groupBy("reason", "field").agg(size, first).unionByName(
        good.groupBy(F.lit("accepted").alias("reason"), F.col("type").alias("field")).agg(size, first))


@register("trajectory_csv_ingest", ops=["S7", "V8", "V9", "V10"], views=["traj"], sql="""
WITH fed AS (SELECT unit_id, cycle AS line, cycle + CASE WHEN l_quantity = 50 AND l_linenumber = 7 THEN 1 ELSE 0 END AS stated FROM traj),
s AS (SELECT *, stated - lag(stated) OVER (PARTITION BY unit_id ORDER BY line) AS step FROM fed),
r AS (SELECT *, CASE WHEN step = 0 THEN 'duplicate cycle' WHEN step < 0 THEN 'cycle not increasing'
                     WHEN step > 1 THEN 'cycle not consecutive' END AS reason FROM s)
SELECT unit_id, count(reason) AS rejected_lines, CASE WHEN count(reason) = 0 THEN count(*) ELSE 0 END AS accepted_rows,
       CAST(CASE WHEN count(reason) = 0 THEN sum(stated) ELSE 0 END AS BIGINT) AS accepted_cycle_sum,
       min(CASE WHEN reason IS NOT NULL THEN line END) AS first_line,
       arg_min(reason, line) FILTER (WHERE reason IS NOT NULL) AS first_reason
FROM r GROUP BY unit_id""")
def trajectory_csv_ingest(spark, sf_dir):
    """The fleet as CSV files, one per unit and some with a repeated or skipped
    cycle, read back: accepted files whole, the others by their first fault."""
    bump = F.when((F.col("l_quantity") == 50) & (F.col("l_linenumber") == 7), 1).otherwise(0)
    fed = tables.traj(spark, sf_dir).select("unit_id", F.col("cycle").alias("at"), (F.col("cycle") + bump).alias("cycle"), "sensor_1", "sensor_4")
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    fed.repartition("unit_id").sortWithinPartitions("unit_id", "at").drop("at").write.partitionBy("unit_id").option("header", True).csv(path)
    good, bad = readers.read_trajectory_csv(spark, path, ["cycle", "sensor_1", "sensor_4"], whole_files=True)
    unit = F.regexp_extract("file", r"unit_id=(\d+)", 1).cast("long").alias("unit_id")
    kept = good.groupBy(unit).agg(F.count(F.lit(1)).alias("_rows"), F.sum("cycle").alias("_sum"))
    faults = bad.groupBy(unit).agg(F.count(F.lit(1)).alias("_bad"), F.min("line").alias("first_line"), F.min_by("reason", "line").alias("first_reason"))
    none = F.lit(0).cast("long")
    return kept.join(faults, "unit_id", "full").select(
        "unit_id", F.coalesce("_bad", none).alias("rejected_lines"), F.coalesce("_rows", none).alias("accepted_rows"),
        F.coalesce("_sum", none).alias("accepted_cycle_sum"), "first_line", "first_reason")
