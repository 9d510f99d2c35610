"""Contract state of a stream by unit, and the latest-row table."""

import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from wearline.plans import REGISTRY
from wearline.streaming import units
from wearline.streaming.latest import LatestTable

SCHEMA = "unit_id long, cycle long, arrival long, exceeded boolean, s double"


def by_hand(rows):
    """Statuses of one unit's rows in order, from the sets of what was accepted."""
    accepted, out = [], []
    for cycle, value in rows:
        if value is None or not np.isfinite(value):
            out.append("non_numeric")
        elif not accepted:
            out.append("ok" if cycle > 0 else "non_positive")
        elif cycle in accepted:
            out.append("duplicate")
        elif cycle < accepted[0]:
            out.append("out_of_order")
        else:
            out.append("ok" if cycle == accepted[-1] + 1 else "gap")
        if out[-1] == "ok":
            accepted.append(cycle)
    return out


def feed(n, units_, seed):
    rng = random.Random(seed)
    rows, at = [], {u: rng.randrange(3) for u in units_}
    for arrival in range(n):
        u = rng.choice(units_)
        step = rng.choices([1, 0, -1, 2, -9], [12, 1, 1, 1, 1])[0]
        at[u] = max(at[u], at[u] + step) if step == 1 else at[u]
        value = None if rng.random() < 0.03 else float("nan") if rng.random() < 0.02 else rng.random()
        rows.append((u, at[u] if step == 1 else at[u] + step, arrival, rng.random() < 0.4, value))
    return rows


def run(spark, rows, tmp_dir, files=1, piece=1 << 16):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    cuts = np.linspace(0, len(rows), files + 1).astype(int)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = rows[a:b]
        random.Random(i).shuffle(part)  # a batch comes in any order
        path = os.path.join(src, f"part-{i:03d}.parquet")
        frame = pd.DataFrame(part, columns=["unit_id", "cycle", "arrival", "exceeded", "s"])
        frame.astype({"s": "float64"}).to_parquet(path, index=False)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    out = units.contract_stream(stream, ["s"], piece=piece)
    q = out.writeStream.format("parquet").option("path", os.path.join(tmp_dir, "out")).option(
        "checkpointLocation", os.path.join(tmp_dir, "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(os.path.join(tmp_dir, "out")).toPandas()


def bag(frame):
    return sorted(map(str, frame.sort_index(axis=1).astype(object).where(frame.notna(), None).to_dict("records")))


def test_statuses_equal_those_by_hand():
    for seed in range(40):
        rows = [(c, v) for _, c, _, _, v in feed(200, [1], seed)]
        got, first, last = units.statuses([c for c, _ in rows], [v is not None and bool(np.isfinite(v)) for _, v in rows], None, None)
        assert got == by_hand(rows)
        ok = [c for (c, _), s in zip(rows, got, strict=True) if s == "ok"]
        assert (first, last) == ((ok[0], ok[-1]) if ok else (None, None)) and ok == list(range(ok[0], ok[-1] + 1)) if ok else True


def test_a_hot_unit_in_pieces_and_batches_gives_the_rows_of_one_pass(spark, tmp_dir):
    rows = feed(3000, [7] * 6 + [1, 2, 3], 5) + [(5, 1, 3000, False, 1.0), (5, 2, 3001, False, 1.0)]
    whole = run(spark, rows, os.path.join(tmp_dir, "whole"))
    pieces = run(spark, rows, os.path.join(tmp_dir, "pieces"), files=3, piece=64)
    assert len(whole) == len(rows) and bag(whole) == bag(pieces)
    for u in (7, 1, 2, 3, 5):
        expected = by_hand([(c, v) for unit, c, _, _, v in rows if unit == u])
        assert sorted(expected) == sorted(whole[whole.unit_id == u].status)
    assert set(whole.status) == {"ok", "duplicate", "out_of_order", "gap", "non_numeric"} | (set(whole.status) & {"non_positive"})
    ok = whole[(whole.unit_id == 7) & (whole.status == "ok")].sort_values("cycle")
    values = [v for c, v in sorted({(c, v) for (unit, c, _, _, v), s in zip(
        [r for r in rows if r[0] == 7], by_hand([(r[1], r[4]) for r in rows if r[0] == 7]), strict=True) if s == "ok"})]
    assert np.allclose(ok.s_rolling_mean_5.astype(float), pd.Series(values).rolling(5, min_periods=1).mean())
    assert whole[whole.status != "ok"][["s_lag_1", "exceeded", "recent_count"]].isna().all().all()


class _Handle:
    """State of one key without a stream."""

    def __init__(self):
        self.map, self.value, self.timers, self.most = {}, None, [], 0
        handle = self

        class Value:
            exists = staticmethod(lambda: handle.value is not None)
            get = staticmethod(lambda: handle.value)

            @staticmethod
            def update(v):
                handle.value = v

            @staticmethod
            def clear():
                handle.value = None

        class Map:
            getValue = staticmethod(lambda k: handle.map[k])
            removeKey = staticmethod(lambda k: handle.map.pop(k))

            @staticmethod
            def updateValue(k, v):
                handle.map[k] = v

        self.getValueState = lambda *a: Value
        self.getMapState = lambda *a: Map
        self.listTimers = lambda: list(self.timers)
        self.deleteTimer = self.timers.remove
        self.registerTimer = self.timers.append


class _Now:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def frames(n, size):
    order = np.random.default_rng(1).permutation(n)
    for i in range(0, n, size):
        a = order[i : i + size]
        yield pd.DataFrame({"unit_id": 1, "cycle": a + 1, "arrival": a, "exceeded": False, "s": a / 2.0})


def test_memory_holds_one_block_and_state_is_left_clean():
    p = units.UnitProcessor(["s"], 5, 3, None, 500)
    handle = _Handle()
    p.init(handle)
    blocks = list(p.in_order(frames(20_000, 170)))
    assert max(map(len, blocks)) == 500 and handle.map == {}
    assert np.array_equal(np.concatenate([b.arrival for b in blocks]), np.arange(20_000))


def test_idle_units_are_forgotten_and_timers_are_renewed():
    p = units.UnitProcessor(["s"], 5, 3, 1000, 500)
    handle = _Handle()
    p.init(handle)
    for now in (50, 90):
        list(p.handleInputRows((1,), frames(3, 10), _Now(now)))
    assert handle.timers == [1090] and handle.value is not None
    assert list(p.handleExpiredTimer((1,), _Now(2000), None)) == [] and handle.value is None
    (again,) = p.handleInputRows((1,), frames(3, 10), _Now(3000))
    assert list(again.status) == ["ok"] * 3


def test_registered_stream_holds_every_reject(spark):
    rows = REGISTRY["stream_contract_status"].build(spark, SF_SMALL)
    found = {r.status for r in rows.select("status").distinct().collect()}
    assert found == {"ok", "duplicate", "out_of_order", "gap", "non_positive", "non_numeric"}


# latest-row table ------------------------------------------------------------

@pytest.fixture()
def table(spark, tmp_dir):
    return LatestTable(spark, os.path.join(tmp_dir, "latest"), buckets=8)


def batch(spark, rows):
    return spark.createDataFrame([(u, c, f"{u}-{c}-{n}") for u, c, n in rows], "unit_id long, cycle long, note string")


def state(table):
    return {r.unit_id: (r.cycle, r.note) for r in table.read().collect()}


def files(table):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(table.path) for f in fs if not f.endswith(".crc"))


def test_newest_row_wins_over_batches_and_repeats(spark, table):
    expected, rng = {}, random.Random(4)
    for b in range(12):
        rows = [(rng.randrange(30), rng.randrange(50), b) for _ in range(rng.randrange(0, 25))]
        table.merge(batch(spark, rows), b)
        for u, c, n in rows:
            if u not in expected or (c, n) >= (expected[u][0], int(expected[u][1].rsplit("-", 1)[1])):
                expected[u] = (c, f"{u}-{c}-{n}")
        assert state(table) == expected
    before = files(table)
    assert table.merge(batch(spark, [(1, 999, 0)]), 11) == 0 and files(table) == before and state(table) == expected


def test_rows_written_follow_the_batch_and_old_files_go(spark, table):
    table.merge(spark.range(4000).selectExpr("id unit_id", "1L cycle", "'first' note"), 0)
    written = [table.merge(batch(spark, [(u, 2 + b, b) for u in range(b, b + 4)]), b + 1) for b in range(12)]
    assert max(written) < 100 and sum(written) < 400  # the table holds 4000 rows
    manifest = json.loads(open(files(table)[0]).read()) if files(table)[0].endswith(".json") else None
    assert manifest is None or len(manifest) == 8
    assert len([f for f in files(table) if "/manifest/" in f]) == 2 and not [f for f in files(table) if "/staged/" in f]
    runs = {f.split("/runs/")[1].split("/part")[0] for f in files(table) if "/runs/" in f and "part-" in f}
    assert len(runs) <= 2 * 8 * 6
    assert table.read().count() == 4000


def test_a_batch_that_failed_before_its_commit_is_taken_in_once(spark, table, monkeypatch):
    table.merge(batch(spark, [(1, 1, 0), (2, 1, 0)]), 0)
    monkeypatch.setattr(table, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.merge(batch(spark, [(1, 5, 1)]), 1)
    assert state(table) == {1: (1, "1-1-0"), 2: (1, "2-1-0")}
    monkeypatch.undo()
    table.merge(batch(spark, [(1, 5, 1)]), 1)
    assert state(table) == {1: (5, "1-5-1"), 2: (1, "2-1-0")}


def test_null_units_and_empty_batches(spark, table):
    table.merge(batch(spark, []), 0)
    assert state(table) == {}
    table.merge(batch(spark, [(3, 1, 0)]).unionByName(batch(spark, [(3, 9, 1)]).withColumn("unit_id", F.lit(None).cast("long"))), 1)
    assert state(table) == {3: (1, "3-1-0")}
