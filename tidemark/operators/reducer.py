"""Windows to segments: a fold in time order whose decisions depend on what the open segment has become."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.brands import ALIASES, canonicalize_brand
from tidemark.functions.text import fold, once_each, tokens

SHOWN = ("artist", "track_title", "brand_name", "transcript_excerpt", "confidence")
KEY = ("category", "artist_key", "title_key", "brand_key", "song_id", "commercial_id")
SEGMENT = "timestamp_start timestamp, timestamp_end timestamp, category string, artist string, track_title string, brand_name string, song_id bigint, commercial_id bigint, transcript_excerpt string, confidence double"


@dataclass(frozen=True)
class Rules:
    """Seconds that an unknown song may bridge, similarities that join neighbouring ads, and their joint length."""

    bridge: float = 60.0
    similar: float = 0.35
    absorb: float = 0.55
    longest: float = 90.0


@dataclass
class Part:
    """An open stretch: its key, when it began, and what to show for it."""

    key: tuple
    start: datetime
    shown: dict = field(default_factory=dict)
    words: list = field(default_factory=list)
    brand: str = ""

    def take(self, row: dict) -> None:
        """The latest values that are there win."""
        self.shown.update({k: row[k] for k in SHOWN if row[k] is not None})
        if row["transcript_excerpt"] is not None:
            self.words = row["words"]
        if row["brand_name"] is not None:
            self.brand = row["brand_identity"]

    def closed(self, end: datetime) -> dict:
        category, _, _, _, song, ad = self.key
        return {"timestamp_start": self.start, "timestamp_end": end, "category": category, "song_id": song, "commercial_id": ad} | {k: self.shown.get(k) for k in SHOWN}


def similarity(a: list[str], b: list[str]) -> float:
    """The greater of Jaccard and bag-of-words cosine."""
    if not a or not b:
        return 0.0
    x, y = Counter(a), Counter(b)
    both = x.keys() & y.keys()
    dot = sum(x[t] * y[t] for t in both)
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return max(len(both) / len(x.keys() | y.keys()), dot / norm)


class Fold:
    """Feeds rows in time order and yields closed segments. It holds one open part and one bridge."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.now: Part | None = None
        self.bridge: Part | None = None

    @staticmethod
    def _open(row: dict) -> Part:
        part = Part(row["key"], row["window_start"])
        part.take(row)
        part.words = row["words"] if row["transcript_excerpt"] is not None else []
        return part

    @staticmethod
    def _unknown(key: tuple) -> bool:
        return key[0] == "SONG" and key[1] is None and key[2] is None and key[4] is None

    def _identity(self, part: Part) -> str:
        return part.brand or part.key[3] or ""

    def feed(self, row: dict) -> Iterator[dict]:
        key = row["key"]
        if self.now is None:
            self.now = self._open(row)
        elif self.bridge is not None:
            if self._unknown(key):
                self.bridge.take(row)
            elif key == self.now.key and (row["window_start"] - self.bridge.start).total_seconds() <= self.rules.bridge:
                self.bridge = None
                self.now.take(row)
            else:
                yield self.now.closed(self.bridge.start)
                yield self.bridge.closed(row["window_start"])
                self.now, self.bridge = self._open(row), None
        elif self.rules.bridge > 0 and self.now.key[0] == "SONG" and not self._unknown(self.now.key) and self._unknown(key):
            self.bridge = self._open(row)
        elif key == self.now.key:
            self.now.take(row)
        elif self._same_ad(row):
            mine, other = self._identity(self.now), row["brand_identity"] or key[3] or ""
            if (not mine and other) or (self.now.key[5] is None and key[5] is not None):
                self.now.key = key
            self.now.take(row)
        else:
            yield self.now.closed(row["window_start"])
            self.now = self._open(row)

    def _same_ad(self, row: dict) -> bool:
        r, now = self.rules, self.now
        if now.key[0] != "COMMERCIAL" or row["key"][0] != "COMMERCIAL" or r.longest <= 0:
            return False
        if (row["window_start"] - now.start).total_seconds() > r.longest:
            return False
        mine, other = self._identity(now), row["brand_identity"] or row["key"][3] or ""
        alike = similarity(now.words, row["words"] if row["transcript_excerpt"] is not None else [])
        if mine == other:
            return alike >= r.similar
        return r.absorb > 0 and (not mine or not other) and alike >= r.absorb

    def finish(self, end: datetime) -> Iterator[dict]:
        if self.now is not None:
            yield self.now.closed(self.bridge.start if self.bridge else end)
            if self.bridge:
                yield self.bridge.closed(end)
        self.now = self.bridge = None


def _identity_of(brand: Column) -> Column:
    return fold(canonicalize_brand(brand, ALIASES))


def prepared(windows: DataFrame, start: str = "window_start_utc") -> DataFrame:
    """Adds what the fold needs, computed in the JVM: tokens of the transcript and the brand's identity."""
    s = F.col("segment_input")
    identity = F.coalesce(_identity_of(s["brand_name"]), F.lit(""))
    return windows.withColumn("window_start", F.col(start)).withColumn("words", tokens(s["transcript_excerpt"])).withColumn("brand_identity", identity)


def _rows(records: list[dict]) -> Iterator[dict]:
    for r in records:
        s = r["segment_input"]
        if s is None:
            continue
        k = s["key"]
        clean = {n: (None if s[n] is None or s[n] != s[n] else s[n]) for n in SHOWN}
        ids = tuple(None if k[n] is None or k[n] != k[n] else int(k[n]) for n in ("song_id", "commercial_id"))
        key = (k["category"], k["artist_key"], k["title_key"], k["brand_key"], *ids)
        yield clean | {"key": key, "window_start": r["window_start"], "words": list(r["words"]), "brand_identity": r["brand_identity"]}


def to_frame(rows: list[dict], columns: dict) -> pd.DataFrame:
    names = [c.split()[0] for c in SEGMENT.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    for name in ("song_id", "commercial_id"):
        out[name] = out[name].astype("Int64")
    out["confidence"] = out["confidence"].astype("float64")
    for name in ("timestamp_start", "timestamp_end"):
        out[name] = pd.to_datetime(out[name])
    for i, (name, value) in enumerate(columns.items()):
        out.insert(i, name, value)
    return out


def reduce_segments(windows: DataFrame, by: list[str], start: str = "window_start_utc", window_seconds: float = 20.0, rules: Rules | None = None) -> DataFrame:
    """Segments of windows with ``segment_input``, one independent fold for each group (a run's block, say).

    Windows without input change nothing, but the last window of all, with or without one, ends the last
    segment. A block has a bounded length, so a group fits a task; blocks are joined by stitch_runs.
    """
    rules = rules or Rules()
    kinds = dict(windows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", " + SEGMENT

    epoch, micro = datetime(1970, 1, 1), timedelta(microseconds=1)

    def run(block: pa.Table) -> pa.Table:
        at = block["window_start"].cast(pa.int64()).to_numpy()
        block = block.take(pa.array(np.argsort(at, kind="stable")))
        # plain columns; nested ones cost more to read than to fold
        told = [block[c].to_pylist() for c in (*KEY, *SHOWN, "said", "brand_identity", "there")]
        fold_, out, times = Fold(rules), [], [epoch + timedelta(microseconds=t) for t in np.sort(at).tolist()]
        for t, *row in zip(times, *told, strict=True):
            *values, said, identity, there = row
            if there:
                shown = {n: (v if v == v else None) for n, v in zip(SHOWN, values[len(KEY) :], strict=True)}  # NaN is none
                out += fold_.feed(shown | {"key": tuple(values[: len(KEY)]), "window_start": t, "words": said.split(), "brand_identity": identity})
        out += fold_.finish(times[-1] + timedelta(seconds=window_seconds))
        columns = {c: pa.array([block[c][0].as_py()] * len(out), block.schema.field(c).type) for c in by}
        for name, kind in (f.split() for f in SEGMENT.split(", ")):
            told = [r[name] for r in out]
            if kind == "timestamp":
                columns[name] = pa.array([(t - epoch) // micro for t in told], pa.int64()).cast(pa.timestamp("us", "UTC"))
            else:
                columns[name] = pa.array(told, {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[kind])
        return pa.table(columns)

    # times are compared as instants; those without a zone are of the session's
    s = F.col("segment_input")
    rows = windows.select(*by, F.col(start).cast("timestamp").alias("window_start"), s.isNotNull().alias("there"), *[s["key"][k].alias(k) for k in KEY], *[s[c].alias(c) for c in SHOWN])
    rows = rows.where("window_start is not null").withColumn("said", F.array_join(tokens(F.col("transcript_excerpt")), " "))  # a word has no spaces
    rows = once_each(rows, "brand_name", "brand_identity", _identity_of).fillna("", ["brand_identity"])
    return rows.groupBy(*by).applyInArrow(run, schema)
