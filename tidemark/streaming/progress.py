"""How far a run is while it runs: counts of windows by category, told by each micro-batch or by the end of a batch."""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.schemas import CATEGORIES

NAMES = (*CATEGORIES, "UNKNOWN")


def _counts(segment_input: str) -> list[Column]:
    kind = F.coalesce(F.col(f"{segment_input}.key.category"), F.lit("UNKNOWN"))
    return [F.count_if(kind == c).alias(c) for c in NAMES]


def observed(routed: DataFrame, name: str = "windows", segment_input: str = "segment_input") -> tuple[DataFrame, Observation | None]:
    """The funnel's windows, which are counted as they pass, without a pass of their own; windows without segment input are UNKNOWN.

    For a batch the second result has the counts (``.get``) once an action is over; for a stream it is None, and
    ``Progress`` hears the counts of each micro-batch under ``name``.
    """
    if routed.isStreaming:
        return routed.observe(name, *_counts(segment_input)), None
    seen = Observation(name)
    return routed.observe(seen, *_counts(segment_input)), seen


class Progress(StreamingQueryListener):
    """Adds up the counts of streams observed under ``name``; ``tell`` hears each micro-batch's number, counts and the sums."""

    def __init__(self, name: str = "windows", tell: Callable[[int, dict, dict], object] | None = None):
        self.name, self.tell, self.total, self.batches = name, tell, Counter(), []
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        counts = {c: row[c] for c in NAMES}
        with self.lock:
            self.total.update(counts)
            self.batches.append((event.progress.batchId, counts))
            sums = {c: self.total[c] for c in NAMES}
        if self.tell:
            self.tell(event.progress.batchId, counts, sums)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
