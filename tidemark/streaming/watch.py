"""Watching a stream: it is started again when it stands still, and ends when enough has come."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def audio_seconds(sidecars: DataFrame) -> float:
    """The length of all captured chunks together; a chunk without samples or rate counts nothing."""
    return sidecars.agg(F.sum(F.col("samples") / F.nullif(F.col("sample_rate_hz"), F.lit(0)))).first()[0] or 0.0


def run_until(start: Callable[[], StreamingQuery], amount: Callable[[], float], target: float, still: float, poll: float = 5.0, tolerance: float = 0.0, tries: int = 3) -> float:
    """Runs the query that ``start`` starts until ``amount`` says ``target`` or nearly so; returns the last amount.

    Less than ``tolerance`` of the target may lack once something has come. A query whose amount stays the
    same for ``still`` seconds is stopped and started again, as is one that ended or failed; it goes on from
    its checkpoint. After ``tries`` starts in a row that brought nothing RuntimeError tells how far it
    got. The query is stopped in every case. Only numbers come to the driver.
    """
    if target <= 0 or still <= 0 or poll <= 0 or tries < 1:
        raise ValueError("target, still, poll and tries have to be positive")
    idle, now = 0, amount()
    first = now

    def enough() -> bool:
        return now >= target or (now > first and target - now < tolerance)

    while not enough():
        query, before, seen, since, why = start(), now, now, time.monotonic(), None
        try:
            while not enough():
                ended = False
                try:
                    ended = query.awaitTermination(poll)
                except StreamingQueryException as e:
                    ended, why = True, e
                now = amount()
                if now > seen:
                    seen, since = now, time.monotonic()
                if ended or time.monotonic() - since >= still:
                    break
        finally:
            query.stop()
        idle = 0 if now > before else idle + 1
        if idle >= tries and not enough():
            raise RuntimeError(f"{idle} starts in a row brought nothing; {now:g} of {target:g} are there") from why
    return now
