"""Per-unit contract state of an observation stream.

One ``transformWithStateInPandas`` processor per unit accepts one contiguous
run of cycles.  A row gets a status and only ``ok`` rows enter the state:

* ``non_numeric``: a sensor value is missing or not finite;
* ``non_positive``: no row was accepted yet and the cycle is not positive;
* ``duplicate`` / ``out_of_order``: the cycle is not above the last accepted
  one, and was accepted / lies before the first one;
* ``gap``: the cycle skips the next one.

Accepted rows carry the temporal features and the persistence alert of the
batch windows.  Rows of a batch are taken by ``arrival``, batches in the order
of the stream; nothing is put in order across batches and nothing is padded.

A unit may send any share of a batch: rows beyond ``piece`` are laid into the
state store by blocks of ``arrival`` and taken back block by block, so a task
holds about one block.  State of a unit that is silent for ``idle_ms`` goes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import contracts as C
from ..session import ship_package
from .monitor import STATE_SCHEMA, _fast_rows, _output_schema

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def statuses(cycles: Sequence[int], usable: Sequence[bool], first: int | None, last: int | None) -> tuple[list[str], int | None, int | None]:
    """Status of each row in order, and the first and last accepted cycle after them."""
    out = []
    for cycle, good in zip(cycles, usable, strict=True):
        if not good:
            out.append("non_numeric")
        elif last is None:
            if cycle > 0:
                first = last = cycle
                out.append("ok")
            else:
                out.append("non_positive")
        elif cycle == last + 1:
            last = cycle
            out.append("ok")
        elif cycle > last:
            out.append("gap")
        else:
            out.append("duplicate" if cycle >= first else "out_of_order")
    return out, first, last


def _packed(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class UnitProcessor(StatefulProcessor):
    def __init__(self, sensors: Sequence[str], window: int, required: int, idle_ms: int | None, piece: int):
        self.sensors, self.window, self.required = list(sensors), window, required
        self.idle_ms, self.piece = idle_ms, piece
        self.columns = [f.name for f in _output_schema(self.sensors).fields]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.unit = handle.getValueState("unit", STATE_SCHEMA)
        self.laid = handle.getMapState("laid", "block long, part long", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        for block in self.in_order(rows):
            yield self.advance(key, block)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.unit.clear()
        return iter(())

    def close(self) -> None:
        pass

    def in_order(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The unit's rows of this batch by arrival, about ``piece`` at a time."""
        held, size, laid = [], 0, {}

        def lay() -> None:
            rows = pd.concat(held, ignore_index=True)
            for block, part in rows.groupby(rows["arrival"].to_numpy(np.int64) // self.piece):
                parts = laid.setdefault(int(block), 0)
                self.laid.updateValue((int(block), parts), (_packed(part),))
                laid[int(block)] = parts + 1
            held.clear()

        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size > self.piece:
                lay()
                size = 0
        if held and laid:
            lay()
        if held:
            yield pd.concat(held, ignore_index=True).sort_values("arrival", kind="stable")
        for block in sorted(laid):
            parts = []
            for part in range(laid[block]):
                parts.append(_unpacked(bytes(self.laid.getValue((block, part))[0])))
                self.laid.removeKey((block, part))
            yield pd.concat(parts, ignore_index=True).sort_values("arrival", kind="stable")

    def advance(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        """Statuses and features of some rows in order; moves the state on."""
        first, cycles, values, flags = self.unit.get() if self.unit.exists() else (None, [], [], [])
        cycles, values, flags = list(cycles), [list(v) for v in values], list(flags)
        usable = np.isfinite(rows[self.sensors].to_numpy(dtype=float)).all(axis=1) & rows["cycle"].notna().to_numpy()
        given = rows["cycle"].fillna(0).to_numpy(dtype=np.int64)
        status, first, _ = statuses(given.tolist(), usable.tolist(), first, cycles[-1] if cycles else None)
        accepted = np.array([s == "ok" for s in status], bool)
        good = None
        if accepted.any():
            good, cycles, values, flags = _fast_rows(key, cycles, values, flags, rows[accepted], self.sensors, self.window, self.required)
            self.unit.update((first, cycles, values, flags))
        # one frame from arrays: most units send few rows, and a frame costs more than they do
        out = {"unit_id": np.full(len(rows), int(key[0]), np.int64), "cycle": rows["cycle"].astype("Int64").to_numpy(), "status": status}
        for name in self.columns[3:]:
            found = good[name].to_numpy() if good is not None else []
            if name in ("exceeded", "alert_active"):
                laid = np.zeros(len(rows), bool)
                laid[accepted] = found
                out[name] = pd.arrays.BooleanArray(laid, ~accepted)
            elif name in ("recent_count", "recent_size"):
                laid = np.zeros(len(rows), np.int64)
                laid[accepted] = found
                out[name] = pd.arrays.IntegerArray(laid, ~accepted)
            else:
                laid = np.full(len(rows), np.nan)
                laid[accepted] = found
                out[name] = laid
        return pd.DataFrame(out, columns=self.columns)


def contract_stream(stream: DataFrame, sensors: Sequence[str], window: int = C.PERSISTENCE_WINDOW, required: int = C.PERSISTENCE_REQUIRED_COUNT,
                    idle_ms: int | None = None, piece: int = 1 << 16) -> DataFrame:
    """Status, features and alert of every row of ``stream``, append mode.

    ``stream`` needs unit_id (long), cycle (long), arrival (long, the order of a
    unit's rows; close to a counter, since ``piece`` of its values make a
    block), ``exceeded`` and the sensors.  Rows without a unit form one unit of
    their own and must be filtered before; a missing cycle is ``non_numeric``.
    """
    spark = stream.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the only store with map state and timers
    columns = stream.select("unit_id", "cycle", "arrival", "exceeded", *sensors)
    return columns.groupBy("unit_id").transformWithStateInPandas(
        UnitProcessor(sensors, window, required, idle_ms, piece), _output_schema(sensors), "append",
        "None" if idle_ms is None else "ProcessingTime")
