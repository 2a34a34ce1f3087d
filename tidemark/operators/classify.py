"""A capture from its windows to events: all tiers, then the segment reducer, then the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.funnel import run_funnel
from tidemark.operators.reducer import Rules, reduce_segments
from tidemark.operators.repair import append_segments
from tidemark.operators.resolve import cut
from tidemark.operators.speech import LEAST_RMS, speech_tier
from tidemark.schemas import Tables

Model = Callable[[DataFrame], DataFrame]


def route_windows(windows: DataFrame, listen: Model, ask: Model, transcribe: Model, judge: Model, least_rms: float = LEAST_RMS, **options) -> DataFrame:
    """Windows of ``sources.capture`` with stage, segment_input and what the tiers said, without their samples.

    ``listen`` takes (key, pcm, sample_rate_hz) of all windows and returns (key, fp, ac): the fingerprint's match and
    the acoustic classes. ``ask`` takes the same of the music windows that need the external service and returns
    (key, sz); ``transcribe`` and ``judge`` are those of ``speech_tier``. Each is called once for a window, and
    what it says is written before it is used. Windows that ``listen`` doesn't tell of are an unmatched window without
    classes, which goes to the speech tier. ``options`` are those of ``plan_tiers``. No window gives none.
    """
    keyed = windows.withColumn("key", F.concat_ws("@", "run_id", F.unix_micros("window_start")))
    audio = keyed.select("key", "pcm", "sample_rate_hz")
    heard = cut(listen(audio).select("key", "fp", "ac"))
    rows = keyed.drop("pcm").join(heard, "key", "left")

    def service(need: DataFrame) -> DataFrame:
        return ask(audio.join(need.select("key"), "key", "left_semi"))

    def speak(need: DataFrame) -> DataFrame:
        loud = audio.join(need.select("key"), "key", "left_semi").select("key", "pcm")
        return speech_tier(loud, "key", transcribe, judge, least_rms=least_rms)

    return run_funnel(rows, ["run_id"], ["window_start", "key"], "key", service, speak, **options)


def classify(tables: Tables, windows: DataFrame, run_id: int | None, listen: Model, ask: Model, transcribe: Model, judge: Model, now=None, window_seconds: float = 20.0, rules: Rules | None = None, **options) -> Tables:
    """``tables`` with the events of the windows of a capture, under the id of its run.

    A chunk's windows are one fold of the reducer; what goes on in the next chunk is a segment of its own, which
    the stitching repairs join. See ``route_windows`` for the models. Windows skipped by all tiers make no event.
    """
    routed = cut(route_windows(windows, listen, ask, transcribe, judge, **options).select("run_id", "block_index", "window_start", "segment_input"))
    segments = reduce_segments(routed, ["run_id", "block_index"], "window_start", window_seconds, rules)
    return append_segments(tables, segments.drop("run_id", "block_index"), run_id, now)
