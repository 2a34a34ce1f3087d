"""The segment reducer as a stream: rows wait in state until the watermark passes them, then fold in order."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.reducer import SEGMENT, SHOWN, Fold, Part, Rules, _rows, prepared, to_frame
from tidemark.operators.repair import append_segments
from tidemark.schemas import DDL, Tables

#: The state store that keeps each value of a group for itself, so that a batch writes what it changes.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "category string, artist_key string, title_key string, brand_key string, song_id bigint, commercial_id bigint, start bigint, artist string, track_title string, brand_name string, transcript_excerpt string, confidence double, words array<string>, brand string"


def _micros(t: datetime) -> int:
    return round((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))


def _time(micros: int) -> datetime:
    return datetime(1970, 1, 1) + timedelta(microseconds=micros)


def _as_state(key: tuple, start: datetime, shown: dict, words: list, brand: str) -> tuple:
    return (*key, _micros(start), *[shown.get(c) for c in SHOWN], list(words), brand)


def _row(kept: tuple) -> dict:
    return dict(zip(SHOWN, kept[7:12], strict=True)) | {"key": tuple(kept[:6]), "window_start": _time(kept[6]), "words": list(kept[12]), "brand_identity": kept[13]}


def _part(kept: tuple) -> Part:
    shown = {k: v for k, v in zip(SHOWN, kept[7:12], strict=True) if v is not None}
    return Part(tuple(kept[:6]), _time(kept[6]), shown, list(kept[12]), kept[13])


class Segments(StatefulProcessor):
    """Of each group: a map of rows that wait, by start and arrival, the open part and its bridge, and the latest start.

    Timers on event time let go of rows that the watermark has passed, and finish a group that is idle.
    """

    def __init__(self, by: list[str], rules: Rules, idle: float, window: float):
        self.by, self.rules, self.idle, self.window = by, rules, idle, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "start bigint, nr bigint", _STATE)
        self.open, self.bridge = handle.getValueState("open", _STATE), handle.getValueState("bridge", _STATE)
        self.seen = handle.getValueState("seen", "last bigint, nr bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, nr = self.seen.get() if self.seen.exists() else (None, 0)
        for frame in rows:
            if len(frame):
                top = _micros(frame["window_start"].max().to_pydatetime())
                last = top if last is None else max(last, top)
            for r in _rows([r | {"window_start": r["window_start"].to_pydatetime()} for r in frame.to_dict("records")]):
                nr += 1
                self.waiting.updateValue((_micros(r["window_start"]), nr), _as_state(r["key"], r["window_start"], r, r["words"], r["brand_identity"]))
        self.seen.update((last, nr))
        yield from self._go_on(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.seen.exists():
            yield from self._go_on(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _go_on(self, key: tuple, mark: int) -> Iterator[pd.DataFrame]:
        last = self.seen.get()[0]
        over = last // 1000 + round(self.idle * 1000)
        done = mark >= over
        places = sorted(tuple(k) for k in self.waiting.keys())  # noqa: SIM118
        ready = [k for k in places if done or k[0] < mark * 1000]
        fold = Fold(self.rules)
        fold.now = _part(self.open.get()) if self.open.exists() else None
        fold.bridge = _part(self.bridge.get()) if self.bridge.exists() else None
        out = []
        for place in ready:
            out += fold.feed(_row(self.waiting.getValue(place)))
            self.waiting.removeKey(place)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if done:
            out += fold.finish(_time(last) + timedelta(seconds=self.window))
            for state in (self.waiting, self.open, self.bridge, self.seen):
                state.clear()
        else:
            if ready:
                for state, part in ((self.open, fold.now), (self.bridge, fold.bridge)):
                    if part is None:
                        state.clear()
                    else:
                        state.update(_as_state(part.key, part.start, part.shown, part.words, part.brand))
            for when in {over, *([places[-1][0] // 1000 + 1] if len(ready) < len(places) else [])}:
                self.handle.registerTimer(max(when, mark + 1))
        if out:
            yield to_frame(out, dict(zip(self.by, key, strict=True)))


def stream_segments(windows: DataFrame, by: list[str], start: str = "window_start_utc", late: str = "1 minute", idle_seconds: float = 60.0, window_seconds: float = 20.0, rules: Rules | None = None) -> DataFrame:
    """Closed segments of a stream of windows, as in reduce_segments.

    Windows later than ``late`` are dropped. Once the watermark is ``idle_seconds`` past a group's last
    window the group is finished, which closes its last segment. The session is set to keep streams' state in
    RocksDB, where a batch writes only the rows and parts it touches, however long a group has been open.
    """
    windows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = dict(windows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", " + SEGMENT
    rows = prepared(windows, start).select(*by, "window_start", "segment_input", "words", "brand_identity").withWatermark("window_start", late)
    return rows.groupBy(*by).transformWithStateInPandas(Segments(by, rules or Rules(), idle_seconds, window_seconds), schema, "append", "eventTime")


def store_segments(segments: DataFrame, path: str, checkpoint: str, run_id: int | None = None) -> StreamingQuery:
    """Starts a query that keeps closed segments as events under ``path``, with the id of a known brand name.

    Each micro-batch is one folder under ``path``/events, written over if the batch comes again, so a
    restart neither loses nor repeats segments. An event's id is its batch's number times 2**40 plus its
    place in the batch.
    """
    spark = segments.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        tables = Tables.empty(spark).having(brands=spark.read.schema(DDL["brands"]).parquet(f"{path}/brands"))
        made = append_segments(tables, batch.select(*[c.split()[0] for c in SEGMENT.split(", ")]), run_id).events
        made.withColumn("id", F.col("id") + F.lit(number << 40)).write.mode("overwrite").parquet(f"{path}/events/batch={number}")

    return segments.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).start()
