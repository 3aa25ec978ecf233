"""Causal operators over streams; each gives, on the whole input, what its batch form gives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions import walks

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows of a key that wait in one value, at most.
INLINE = 2048


def stream_sessions(events: DataFrame, gap_micros: int, key: str = "user_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Sessions by key: start, last event and size. A gap of exactly the length splits, so the window is a microsecond shorter."""
    window = F.session_window(ts, f"{gap_micros - 1} microseconds")
    return events.withWatermark(ts, late).groupBy(key, window).agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n")).select(key, "start", "last", "n")


def stream_dedupe(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def stream_alarms(events: DataFrame, threshold: float, width: str = "1 day", key: str = "user_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Items at or above the threshold by key and tumbling window, where there are any."""
    hits = events.withWatermark(ts, late).filter(F.col("prob") >= threshold)
    return hits.groupBy(key, F.window(ts, width)).agg(F.count("*").alias("hits")).select(key, F.col("window.start").alias("start"), "hits")


class InOrder(StatefulProcessor):
    """Holds a key's rows back until the watermark has passed them, then hands them on in the order of (time, pos).

    Up to INLINE rows wait in one value, which is read and written at once: each call to the state costs far more
    than a row. Beyond, rows that wait are kept by stretch of time, width long, so a release reads and sorts one
    stretch at a time and no others; one timer for each key, at the end of its earliest stretch, makes releases
    happen. What is carried from row to row (last) has a time to live: a row at least idle behind the one before
    starts anew, and when the watermark is that far the carried state is removed by a timer. Both go by event
    time, so the result depends on the rows alone, not on batches. A null value is one that differs from none.
    """

    def __init__(self, width_micros: int, idle_micros: int) -> None:
        self.width, self.idle = width_micros, idle_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # rows (micros, pos, value's bits) in one value, and (stretch, number of parts) of those that are kept by stretch
        self.waiting = handle.getValueState("waiting", StructType([StructField("data", BinaryType()), StructField("parts", BinaryType())]))
        self.rows = handle.getMapState("rows", StructType([StructField("stretch", LongType()), StructField("part", IntegerType())]), StructType([StructField("data", BinaryType())]))
        self.last = handle.getValueState("last", StructType([StructField("micros", LongType()), StructField("carried", DoubleType())]))

    def wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def held(self) -> tuple[np.ndarray, dict[int, int]]:
        got = self.waiting.get() or (b"", b"")
        return np.frombuffer(got[0], np.int64).reshape(3, -1), dict(np.frombuffer(got[1], np.int64).reshape(-1, 2).tolist())

    def hold(self, data: np.ndarray, parts: dict[int, int]) -> None:
        self.waiting.update((data.tobytes(), np.array(list(parts.items()), np.int64).tobytes()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data, parts = self.held()
        for chunk in rows:
            data = np.concatenate([data, np.stack([chunk["micros"].to_numpy(np.int64), chunk["pos"].to_numpy(np.int64), chunk["value"].to_numpy(np.float64).view(np.int64)])], axis=1)
            if data.shape[1] > INLINE:
                stretch = data[0] // self.width
                for at in np.unique(stretch).tolist():
                    n = parts.get(at, 0)
                    self.rows.updateValue((at, n), (data[:, stretch == at].tobytes(),))
                    parts[at] = n + 1
                data = data[:, :0]
        self.hold(data, parts)
        self.wake((min([*parts, *(data[0] // self.width).tolist()]) + 1) * self.width)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        inline, parts = self.held()
        stretch = inline[0] // self.width
        ready = (stretch + 1) * self.width <= now
        due = sorted(at for at in {*parts, *stretch[ready].tolist()} if (at + 1) * self.width <= now)
        was = before = self.last.get()
        apart = any(at in parts for at in due)  # else all that is due is in one value, and sorted together
        for at in due if apart else due[:1]:
            n = parts.pop(at, 0)
            kept = [np.frombuffer(self.rows.getValue((at, k))[0], np.int64).reshape(3, -1) for k in range(n)]
            data = np.concatenate([*kept, inline[:, ready & (stretch == at) if apart else ready]], axis=1)
            micros, pos, value = data[:, np.lexsort((data[1], data[0]))]
            fresh = np.diff(micros, prepend=before[0] if before else micros[0] - self.idle) >= self.idle
            out, carried = self.step(value.view(np.float64), fresh, before[1] if before else float("nan"))
            before = (int(micros[-1]), float(carried))
            for k in range(n):
                self.rows.removeKey((at, k))
            yield pd.DataFrame({"seq_id": key[0], "pos": pos, "out": out})
        inline = inline[:, ~ready]
        wait = [*parts, *stretch[~ready].tolist()]
        if due:
            if wait:
                self.hold(inline, parts)
            else:
                self.waiting.clear()
        if wait:
            self.wake((min(wait) + 1) * self.width)
        elif before:
            if before[0] + self.idle <= now:
                before = None
            else:
                self.wake(before[0] + self.idle)
        if before and before != was:
            self.last.update(before)
        elif was and not before:
            self.last.clear()

    def step(self, value: np.ndarray, fresh: np.ndarray, carried: float) -> tuple[np.ndarray, float]:
        """Results of rows in order, and what the next row has to know."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Transitions(InOrder):
    """Whether an item's label differs from the one before it; the last label is carried."""

    def step(self, value: np.ndarray, fresh: np.ndarray, carried: float) -> tuple[np.ndarray, float]:
        before = np.append(carried, value[:-1])
        return ((before != value) & ~fresh & ~np.isnan(before) & ~np.isnan(value)).astype(np.int64), value[-1]


class Walk(InOrder):
    """The forward half of the two-state smoother; one number is carried."""

    def __init__(self, width_micros: int, idle_micros: int, limit: float) -> None:
        super().__init__(width_micros, idle_micros)
        self.limit = int(walks.fixed(limit))

    def step(self, value: np.ndarray, fresh: np.ndarray, carried: float) -> tuple[np.ndarray, float]:
        d, end = walks.leads(walks.fixed(value), fresh, self.limit, 0 if np.isnan(carried) else int(carried))
        return d / walks.UNIT, float(end)  # below 2^53, so exact


def _stateful(items: DataFrame, value: str, processor: InOrder, name: str, kind: str, ts: str, late: str) -> DataFrame:
    rows = items.select("seq_id", "pos", F.col(value).cast("double").alias("value"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("micros", F.unix_micros("ts"))
    schema = StructType([items.schema["seq_id"], StructField("pos", LongType()), StructField("out", LongType() if kind == "long" else DoubleType())])
    out = rows.groupBy("seq_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.withColumnRenamed("out", name)


def micros(length: str) -> int:
    return round(pd.Timedelta(length).total_seconds() * 1_000_000)


def stream_transitions(items: DataFrame, ts: str = "ts", late: str = "1 hour", width: str = "1 hour", idle: str = "30 days") -> DataFrame:
    """seq_id, pos and is_transition of items (seq_id, pos, label, ts): rows in any order up to late, results as the watermark passes.

    A row later than that is dropped, as streams do. A sequence whose next item is at least idle behind starts anew, and its state is gone by then.
    """
    return _stateful(items, "label", Transitions(micros(width), micros(idle)), "is_transition", "long", ts, late)


def stream_walk(items: DataFrame, limit: float, ts: str = "ts", late: str = "1 hour", width: str = "1 hour", idle: str = "30 days") -> DataFrame:
    """seq_id, pos and lead of items (seq_id, pos, logit, ts): the forward half of the smoother, with the rules of stream_transitions."""
    return _stateful(items, "logit", Walk(micros(width), micros(idle), limit), "lead", "double", ts, late)


def drained(stream: DataFrame, name: str, path: str, mode: str = "append", closing: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """Runs a stream over what there is and returns the result as a table; path is a new folder in shared storage.

    closing is a row of the source, later than all others by more than any window and delay, that ends the
    input: written to the source's folder when the rest has been read, it moves the watermark on, so that
    windows that are still open come out. Its own window stays open and is no part of the result.
    """

    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def run() -> None:
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-state").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    if closing is not None:
        closing.write.mode("append").parquet(source)
        run()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/{name}")
