"""Periodic runs of words: each text is compared with itself at every lag, stretches of equal words are runs."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, stage, tidied

#: Comparisons of a range of lags, about; texts that need more are scanned in several ranges.
RANGE = 50_000
#: Lags up to this one are in each range, as they tell which stretches at greater lags are no runs.
SHORT_LAGS = 64


def _needed(lags: np.ndarray, shortest: int, times: int) -> np.ndarray:
    """How many words in a row must equal those a lag on: a run's length less its period."""
    return np.maximum(shortest - lags, (times - 1) * lags)


def _stretches(ids: np.ndarray, lag: int, shortest: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of period ``lag`` that are long enough and can't be extended."""
    same = np.concatenate(([False], ids[:-lag] == ids[lag:], [False]))
    edge = np.flatnonzero(same[1:] != same[:-1])
    start, stop = edge[::2], edge[1::2]
    long = stop - start >= max(shortest - lag, (times - 1) * lag)
    return start[long], stop[long] + lag


def _prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def _smallest(ids: np.ndarray, start: int, stop: int, lag: int) -> bool:
    """Whether a stretch of period ``lag`` and twice its length has no smaller period, which would divide it."""
    return not any(np.array_equal(ids[start : stop - lag // p], ids[start + lag // p : stop]) for p in _prime_factors(lag))


def runs_of(ids: np.ndarray, shortest: int = 24, times: int = 3, low: int = 1, high: int | None = None, known: int = SHORT_LAGS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs with a period of ``low`` to ``high``, in no order; lags up to ``known`` are scanned in any case.

    All lags are compared at once, each at every place that is a multiple of the stretch it needs, so that
    none is passed over; where a place and its neighbours agree, the lag is compared at all places. A
    place within a stretch of a period that divides the lag says nothing new, as that stretch can't grow.
    """
    n = len(ids)
    lags = np.arange(1, min(n // times, n if high is None else high) + 1)
    lags = lags[(lags >= low) | (lags <= known)]
    need = _needed(lags, shortest, times)
    places = np.maximum(0, -(-(n - lags) // need))
    lag, step = np.repeat(lags, places), np.repeat(need, places)
    at = (np.arange(len(lag)) - np.repeat(places.cumsum() - places, places)) * step
    hit = ids[at] == ids[at + lag]
    lag, at = lag[hit], at[hit]
    beside = min(3, (int(need.min(initial=1)) - 1) // 2)
    right, left = np.ones(len(lag), bool), np.ones(len(lag), bool)
    for j in range(1, beside + 1):
        inside = at + j + lag < n
        right &= inside & (ids[np.where(inside, at + j, 0)] == ids[np.where(inside, at + j + lag, 0)])
        inside = at >= j
        left &= inside & (ids[np.where(inside, at - j, 0)] == ids[np.where(inside, at - j + lag, 0)])
    lag, at = lag[right | left], at[right | left]
    found = []
    while len(lag):
        q = int(lag[0])
        start, stop = _stretches(ids, q, shortest, times)
        if q >= low:
            found += [(s, e - s, q) for s, e in zip(start.tolist(), stop.tolist(), strict=True) if _smallest(ids, s, e, q)]
        told = lag == q
        if len(start):
            mine = np.searchsorted(start, at, side="right") - 1
            told |= (lag % q == 0) & (mine >= 0) & (at + lag < stop[mine])
        lag, at = lag[~told], at[~told]
    return found


def lag_ranges(n: int, shortest: int = 24, times: int = 3, size: int = RANGE) -> list[tuple[int, int]]:
    """Ranges of lags of about as many comparisons, ``size`` or the text's own words; a text is copied for each."""
    work = -(-(n - (lags := np.arange(1, n // times + 1))) // _needed(lags, shortest, times)) if n >= shortest else np.empty(0, np.int64)
    total = work.cumsum()
    if not len(work) or total[-1] <= size:
        return [(1, max(1, n // times))]
    pieces = -(-int(total[-1]) // max(size, n))
    cut = np.unique(np.searchsorted(total, total[-1] * np.arange(1, pieces) / pieces)) + 1
    return list(zip([1, *(cut + 1).tolist()], [*cut.tolist(), len(work)], strict=True))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text, its words joined by a space, without what runs repeat of their first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(change[:-1].cumsum() == 0)])


def _result(words: list[bytes], runs: list[tuple[int, int, int]]) -> dict:
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    start, length, period = best
    return {
        "n_runs": len(runs), "start": start, "length": length, "period": period, "exponent_milli": None if start is None else 1000 * length // period,
        "runs": [{"start": s, "length": n, "period": p} for s, n, p in runs], "collapsed": _collapsed(words, runs),
    }


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = [("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")], ("runs", pa.list_(_RUN)), ("collapsed", pa.binary())]
_DEALT = [("nr", pa.int64()), ("doc_id", pa.int64()), ("text", pa.binary()), ("ids", pa.binary()), ("ranges", pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))]
_TOLD = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def numbered(words: list[bytes]) -> np.ndarray:
    """The words as numbers, equal ones alike."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def long_text(shortest: int = 24, times: int = 3, size: int = RANGE) -> int:
    """The bytes from which on a text may have words enough for several ranges of lags."""
    low, high = 1, shortest + 1
    while len(lag_ranges(high, shortest, times, size)) == 1:
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if len(lag_ranges(mid, shortest, times, size)) == 1 else (low, mid)
    return 2 * high - 1


def _scan(shortest: int, times: int):
    """(doc_id, text) -> each text's result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                out = []
                for doc, text in zip(some["doc_id"].to_pylist(), some["text"], strict=True):
                    words = (text.as_py() or b"").split()
                    runs = runs_of(numbered(words), shortest, times) if len(words) >= shortest else []
                    out.append({"doc_id": doc} | _result(words, runs))
                yield pa.RecordBatch.from_pylist(out, pa.schema(_OUT))

    return tidied(run)


def _deal(shortest: int, times: int):
    """(doc_id, text) -> each text with its words as packed numbers and the ranges of lags to scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nr = TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                nr += 1
                ids = numbered(text.split())
                ranges = [{"low": a, "high": b} for a, b in lag_ranges(len(ids), shortest, times, RANGE)]
                yield pa.RecordBatch.from_pylist([{"nr": nr, "doc_id": doc, "text": text, "ids": ids.astype("<i4").tobytes(), "ranges": ranges}], pa.schema(_DEALT))

    return tidied(run)


def _scan_range(shortest: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nr, ids, low, high in zip(*(batch[c] for c in ("nr", "ids", "low", "high")), strict=True):
                runs = runs_of(np.frombuffer(ids.as_py(), "<i4"), shortest, times, low.as_py(), high.as_py())
                columns = list(zip(*runs, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array([nr.as_py()] * len(runs), pa.int64()), *[pa.array(c, pa.int64()) for c in columns]], ["nr", "start", "length", "period"])

    return tidied(run)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, runs in zip(batch["doc_id"].to_pylist(), batch["text"], batch["runs"], strict=True):
            runs = [(r["start"], r["length"], r["period"]) for r in runs.as_py() or []]
            out.append({"doc_id": doc} | _result(text.as_py().split(), runs))
        yield pa.RecordBatch.from_pylist(out, pa.schema(_OUT))


def periodic_runs(docs: DataFrame, shortest: int = 24, times: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_runs, the run that repeats most (start, length, period, exponent_milli), all runs, and the collapsed text.

    A run is a stretch of consecutive words with smallest period q, of ``times`` periods and ``shortest`` words
    at least, that no neighbouring word extends. ``runs`` has them by start, then period; ``collapsed`` is the text
    in UTF-8, its words joined by one space, without words that a run has after its first q words. The run
    that repeats most has the greatest length / period, of equals the least start, then period.

    Words are what ASCII white space parts. A text is scanned at all lags where it is read; a long one is
    dealt out in ranges of lags, of about as many comparisons each, and its runs, fewer than its words, meet
    again. Null texts and texts without words have no runs and an empty collapsed text. Each row is judged
    by itself: repeated rows and ids stay, as do rows without an id. Other columns aren't looked at; an empty
    table gives an empty one.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) >= long_text(shortest, times, RANGE)
    long = stage(rows.where(size).mapInArrow(_deal(shortest, times), "nr long, doc_id long, text binary, ids binary, ranges array<struct<low: long, high: long>>"), "long_texts")
    ranges = long.select("nr", "ids", F.inline("ranges").alias("low", "high")).repartition("nr", "low")
    runs = ranges.mapInArrow(_scan_range(shortest, times), "nr long, start long, length long, period long")
    runs = runs.groupBy(F.col("nr").alias("of")).agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    joined = long.select("doc_id", "nr", "text").join(runs, F.col("nr") == F.col("of"), "left").select("doc_id", "text", "runs")
    return rows.where(~size).mapInArrow(_scan(shortest, times), _TOLD).union(joined.mapInArrow(_finish, _TOLD))


def planted(text: Column, doc_id: Column) -> Column:
    """The text of a tenth of the documents with its words from some place on repeated from there; the others as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(F.floor(h / 10), n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(F.floor(h / 10), F.lit(8))))
        again = F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")))
        return F.when(n > 0, F.array_join(again, " ")).otherwise("")

    whole = F.element_at(F.transform(F.array(words), repeat), 1)
    return F.when(F.pmod(h, F.lit(10)) == 0, whole).otherwise(text)


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return periodic_runs(docs).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
