"""The same questions on event streams, with watermarks bounding the state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tracelake.functions.secrets import SHAPES, mask_kind, shape_hits


def live_bursts(events: DataFrame, by: list[str], gap_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Bursts per key; a silence of exactly the gap stays in the burst."""
    return (events.withWatermark("ts", late)
            .groupBy(*by, F.session_window("ts", f"{gap_seconds} seconds").alias("w"))
            .agg(F.count("*").alias("events"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")).drop("w"))


def live_dedupe(events: DataFrame, within: str) -> DataFrame:
    """Repeats of the same source and detail inside the watermark are dropped."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["source", "detail"])


def live_last_per_source(events: DataFrame, late: str = "10 minutes", slot: str = "1 hour") -> DataFrame:
    """Newest event per source and slot; a reader takes the newest slot of each source."""
    newest = F.max(F.struct("ts", "event_id", "kind", "detail")).alias("m")
    return (events.withWatermark("ts", late).groupBy("source", F.window("ts", slot).alias("w"))
            .agg(newest).select("source", F.col("w.start").alias("slot"), "m.*"))


def live_secret_scan(texts: DataFrame, text: str, keep: list[str], shapes: dict = SHAPES) -> DataFrame:
    """Stateless: masked hits per micro-batch row."""
    return (texts.select(*keep, F.explode(shape_hits(F.col(text), shapes)).alias("h"))
            .select(*keep, "h.shape", mask_kind(F.col("h.value"), "token").alias("shown")))


class Newest(StatefulProcessor):
    """Keeps the newest row of a key in a value state and gives it out whenever it changes."""

    def __init__(self, keys: list[str], schema: StructType, time: str, tie: str, forget_ms: int | None) -> None:
        self.keys, self.schema, self.time, self.tie, self.forget = keys, schema, time, tie, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.newest.get()) if self.newest.exists() else None
        at = [self.schema.names.index(self.time), self.schema.names.index(self.tie)]
        rank = lambda row: (row[at[0]], -row[at[1]])
        best = before
        for pdf in rows:
            for row in pdf[self.schema.names].astype(object).where(pdf[self.schema.names].notna(), None).itertuples(index=False, name=None):
                if row[at[0]] is not None and (best is None or rank(row) > rank(best)):
                    best = row
        if best is not None and best != before:
            self.newest.update(tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else int(v) if hasattr(v, "__index__") else v for v in best))
            if self.forget is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(int(pd.Timestamp(best[at[0]]).timestamp() * 1000) + self.forget)
            yield pd.DataFrame([(*key, *best)], columns=[*self.keys, *self.schema.names])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        yield pd.DataFrame([], columns=[*self.keys, *self.schema.names])

    def close(self) -> None:
        pass


def live_newest(events: DataFrame, by: list[str], time: str = "ts", tie: str = "event_id", keep: list[str] = (),
                late: str | None = None, forget_ms: int | None = None) -> DataFrame:
    """The newest event per key (source, service, device) as updates: a row whenever a key's newest changes.

    One row of state per key. Ties go to the smaller ``tie``, as in the batch answer; an event older than
    the key's newest changes nothing, however late it comes, and one without a time is passed over. With
    ``late`` and ``forget_ms`` a key is forgotten once the watermark is that far past its newest event:
    rows later than the watermark are then dropped, and a key that comes back starts afresh. State needs
    the RocksDB store (``spark.sql.streaming.stateStore.providerClass``). Write it with output mode
    ``update``; the last row of a key is its answer.
    """
    if (late is None) != (forget_ms is None):
        raise ValueError("late and forget_ms belong together")
    rows = events if late is None else events.withWatermark(time, late)
    wanted = rows.select(*by, time, tie, *keep)
    state = StructType([f for f in wanted.schema.fields if f.name not in by])
    schema = StructType([*(wanted.schema[k] for k in by), *state.fields])
    return wanted.groupBy(*by).transformWithStateInPandas(
        Newest(list(by), state, time, tie, forget_ms), schema, "update", "none" if late is None else "eventtime")
