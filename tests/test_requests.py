"""Strict request ingest: one reason per kind of fault, types seen before any cast."""

import json

import pytest
from pyspark.sql import functions as F

from wearline.sources import requests as R

TINY = R.Form((R.Field("cycle", "integer", above=0), R.Field("sensor_2")))
GOOD = {"unit_id": 7, "observations": [{"cycle": 1, "sensor_2": 5}, {"cycle": 2, "sensor_2": -0.25}]}


def observation(**change):
    first = {"cycle": 1, "sensor_2": 5.5} | change
    return json.dumps({"unit_id": 7, "observations": [{k: v for k, v in first.items() if v != "absent"}]})


def read(spark, bodies, form=TINY):
    rows = [(f"r{i}", b, "clash", 1.0) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "request_id string, body string, reason string, cycle double")
    good, bad = R.read_requests(df, form)
    return good.collect(), [tuple(r) for r in bad.collect()]


FAULTS = [
    (observation(sensor_2="5"), "observations[0]", "sensor_2", "text"),
    (observation(sensor_2=True), "observations[0]", "sensor_2", "boolean"),
    (observation(sensor_2=None), "observations[0]", "sensor_2", "null"),
    (observation(sensor_2={}), "observations[0]", "sensor_2", "object"),
    (observation(sensor_2=[1]), "observations[0]", "sensor_2", "array"),
    (observation(sensor_2="absent"), "observations[0]", "sensor_2", "missing"),
    (observation().replace("5.5", "1e999"), "observations[0]", "sensor_2", "not finite"),
    (observation(rul=3), "observations[0]", "rul", "unknown"),
    (observation(cycle=1.5), "observations[0]", "cycle", "not an integer"),
    (observation(cycle=True), "observations[0]", "cycle", "boolean"),
    (observation(cycle="1"), "observations[0]", "cycle", "text"),
    (observation(cycle=0), "observations[0]", "cycle", "too small"),
    (observation(cycle=-3), "observations[0]", "cycle", "too small"),
    (json.dumps({"observations": [7]}), "observations[0]", "", "not an object"),
    (json.dumps(GOOD | {"observations": []}), "", "observations", "empty"),
    (json.dumps(GOOD | {"observations": {}}), "", "observations", "object"),
    (json.dumps(GOOD | {"observations": "x"}), "", "observations", "text"),
    (json.dumps(GOOD | {"observations": 5}), "", "observations", "number"),
    (json.dumps(GOOD | {"observations": None}), "", "observations", "null"),
    (json.dumps({"unit_id": 1}), "", "observations", "missing"),
    (json.dumps(GOOD | {"unit_id": True}), "", "unit_id", "boolean"),
    (json.dumps(GOOD | {"unit_id": 1.5}), "", "unit_id", "number"),
    (json.dumps(GOOD | {"unit_id": []}), "", "unit_id", "array"),
    (json.dumps(GOOD | {"Machine failure": 1}), "", "Machine failure", "unknown"),
    (json.dumps([GOOD]), "", "", "not an object"),
    ("null", "", "", "not an object"),
    (json.dumps(GOOD)[:-1], "", "", "malformed"),
    (json.dumps(GOOD) + " x", "", "", "malformed"),
    (json.dumps(GOOD) + "," + json.dumps(GOOD), "", "", "malformed"),
    (json.dumps(GOOD).replace("-0.25", "NaN"), "", "", "malformed"),
    ('{"unit_id": 1, "unit_id": 2, "observations": []}', "", "", "malformed"),
    ("", "", "", "malformed"),
    (None, "", "", "malformed"),
]


def test_one_reason_per_kind_of_fault(spark):
    good, bad = read(spark, [f[0] for f in FAULTS])
    assert good == []
    assert sorted(bad) == sorted((f"r{i}", *f[1:]) for i, f in enumerate(FAULTS))


def test_good_requests_keep_types_order_and_unit(spark):
    bodies = [json.dumps(GOOD), json.dumps(GOOD | {"unit_id": "engine 7"}), json.dumps(GOOD | {"unit_id": None}), json.dumps({"observations": GOOD["observations"]})]
    good, bad = read(spark, bodies)
    assert bad == []
    units = {r.request_id: r.unit_id for r in good}
    assert units == {"r0": "7", "r1": "engine 7", "r2": None, "r3": None}
    assert [(r.arrival, r.cycle, r.sensor_2) for r in good if r.request_id == "r0"] == [(0, 1, 5.0), (1, 2, -0.25)]


def test_all_faults_of_a_request_are_listed_and_cost_no_other_request(spark):
    many = {"unit_id": {}, "extra": 1, "observations": [{"cycle": 0}, {"cycle": 2, "sensor_2": 1.0}, 3, {"sensor_2": "x", "cycle": None, "TWF": 1}]}
    good, bad = read(spark, [json.dumps(many), json.dumps(GOOD)])
    assert sorted(bad) == sorted([
        ("r0", "", "unit_id", "object"), ("r0", "", "extra", "unknown"), ("r0", "observations[0]", "cycle", "too small"),
        ("r0", "observations[0]", "sensor_2", "missing"), ("r0", "observations[2]", "", "not an object"),
        ("r0", "observations[3]", "cycle", "null"), ("r0", "observations[3]", "sensor_2", "text"), ("r0", "observations[3]", "TWF", "unknown")])
    assert {r.request_id for r in good} == {"r1"} and len(good) == 2


MACHINE = {"type": "M", "air_temperature": 300, "process_temperature": 310.5, "rotational_speed": 1500, "torque": 0, "tool_wear": 0.0}


@pytest.mark.parametrize("change, field, reason", [
    ({"type": "X"}, "type", "not a choice"), ({"type": 1}, "type", "number"), ({"air_temperature": 0}, "air_temperature", "too small"),
    ({"torque": -1}, "torque", "too small"), ({"torque": True}, "torque", "boolean"), ({"rotational_speed": "1500"}, "rotational_speed", "text"),
    ({"TWF": 1}, "TWF", "unknown"), ({"unrelated": 1}, "unrelated", "unknown")])
def test_machine_requests(spark, change, field, reason):
    good, bad = read(spark, [json.dumps(MACHINE), json.dumps(MACHINE | change), json.dumps([MACHINE])], R.FAILURE_REQUEST)
    assert bad == [("r1", "", field, reason), ("r2", "", "", "not an object")]
    assert [(r.request_id, r.type, r.torque, r.process_temperature) for r in good] == [("r0", "M", 0.0, 310.5)]


def test_no_requests_and_a_large_one(spark):
    assert read(spark, []) == ([], [])
    large = {"unit_id": 1, "observations": [{"cycle": i + 1, "sensor_2": i / 4} for i in range(20_000)]}
    df = spark.createDataFrame([("big", json.dumps(large))], "request_id string, body string")
    good, bad = R.read_requests(df, TINY)
    assert bad.isEmpty()
    assert good.agg(F.count("*"), F.max("cycle"), F.sum("sensor_2")).first()[:] == (20_000, 20_000, sum(i / 4 for i in range(20_000)))


def test_the_verdict_is_local_to_the_row(spark):
    df = spark.createDataFrame([("a", "{}")], "request_id string, body string")
    for part in R.read_requests(df, R.RUL_REQUEST):
        assert "Exchange" not in part._jdf.queryExecution().executedPlan().toString()
