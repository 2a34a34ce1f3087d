"""Time: windows, spans, dates, and joins of points with intervals."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


def parse_since(value: str, now: datetime | None = None) -> datetime:
    """A span back from now (90s, 15m, 24h, 7d) or an ISO instant, UTC if it names no zone."""
    text = value.strip()
    if m := re.fullmatch(r"(\d+)\s*([smhdSMHD])", text):
        return (now or datetime.now(UTC)) - timedelta(**{_UNITS[m[2].lower()]: int(m[1])})
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"neither a span nor an instant: {value!r}") from None
    return at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)


def resolve_window(since: str | None = None, from_: str | None = None, to: str | None = None, now: datetime | None = None) -> tuple[datetime, datetime | None]:
    """(begin, end) of a report; a span excludes explicit ends, and the default is 24 hours."""
    if since and (from_ or to):
        raise ValueError("give a span or explicit ends, not both")
    if to and not from_:
        raise ValueError("an end needs a beginning")
    begin, end = parse_since(from_ or since or "24h", now), parse_since(to, now) if to else None
    if end is not None and end <= begin:
        raise ValueError("the end must lie after the beginning")
    return begin, end


def iso_ms(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def between(c: Column, since=None, until=None) -> Column:
    """since <= c < until; an end that is None or empty is open."""
    out = F.lit(True)
    if not (since is None or isinstance(since, str) and not since):
        out = out & (c >= F.lit(since))
    if not (until is None or isinstance(until, str) and not until):
        out = out & (c < F.lit(until))
    return out


def span_seconds(start: Column, end: Column) -> Column:
    """Seconds from start to end, negative if end comes first."""
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6


def gap_seconds(prev_end: Column, start: Column) -> Column:
    """Seconds between, 0 where they overlap or one is missing."""
    return F.coalesce(F.greatest(F.lit(0.0), span_seconds(prev_end, start)), F.lit(0.0))


def plus_seconds(t: Column, seconds: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.round(seconds * 1e6).cast("long"), t)


def format_seconds(c: Column) -> Column:
    """12s, 3m04s, 2h05m."""
    s = F.round(F.coalesce(c, F.lit(0.0))).cast("long")
    minutes = F.format_string("%dm%02ds", F.floor(s / 60), s % 60)
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, minutes).otherwise(F.format_string("%dh%02dm", F.floor(s / 3600), F.floor((s % 3600) / 60)))


def partial_date(c: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD as a date, missing parts 1; null if invalid."""
    text = F.trim(c)
    part = [F.regexp_extract(text, r"^(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?$", i) for i in (1, 2, 3)]
    whole = F.concat_ws("-", part[0], F.when(part[1] != "", part[1]).otherwise("01"), F.when(part[2] != "", part[2]).otherwise("01"))
    return F.when(part[0] != "", F.try_to_timestamp(whole, F.lit("yyyy-MM-dd")).cast("date"))


def earliest_date(first: Column, others: Column) -> Column:
    """The earliest valid one of a partial date and an array of them."""
    return F.array_min(F.transform(F.array_append(F.coalesce(others, F.array().cast("array<string>")), first), partial_date))


def age_years(released: Column, reference: Column) -> Column:
    return F.date_diff(reference, released) / 365.25


def sliding_windows(captures: DataFrame, seconds: float = 20.0, hop: float = 10.0, rate: str = "sample_rate_hz", samples: str = "samples", start: str = "capture_start") -> DataFrame:
    """One row for each full window of a capture; the last partial window goes. hop may not exceed seconds."""
    if not 0 < hop <= seconds:
        raise ValueError("the hop must be positive and no longer than the window")
    size, step = F.round(F.lit(seconds) * F.col(rate)).cast("long"), F.greatest(F.round(F.lit(hop) * F.col(rate)).cast("long"), F.lit(1).cast("long"))
    whole = captures.where(F.col(samples) >= size)
    out = whole.withColumn("first_sample", F.explode(F.sequence(F.lit(0).cast("long"), F.col(samples) - size, step)))
    return out.withColumn("window_start", plus_seconds(F.col(start), F.col("first_sample") / F.col(rate))).withColumn("frame_count", size)


def tumbling_windows(df: DataFrame, ts: str, width: str, *aggs: Column) -> DataFrame:
    return df.groupBy(F.window(ts, width).alias("w")).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*").drop("w")


def as_of(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Each point with the interval that covers it (start <= t < end) and starts last; ties: greatest key.

    An interval without an end covers nothing, as its end counts as its start; points that nothing covers
    drop out. Points that repeat each come back. ``by`` columns have to be equal; null ones match nothing.

    Slots are as wide as the intervals in them, in powers of two of a second, so an interval lies in two of
    its level at most; a point looks into one slot of each level that occurs, of which there are few. What
    covers a time is told once for each different time, and then joined to the points. All tables may be large, and a
    plan takes exploded ones for as small as the files they come from, so nothing here is broadcast.
    """
    t0 = F.lit("1970-01-01").cast("timestamp_ntz")
    micros = lambda c: F.timestamp_diff("MICROSECOND", t0, c.cast("timestamp_ntz"))
    spans = intervals.where(F.col(end) > F.col(start)).select(*by, F.struct(*[c for c in intervals.columns if c not in by]).alias("_i"), micros(F.col(start)).alias("_a"), micros(F.col(end)).alias("_z"))
    spans = spans.withColumn("_level", F.ceil(F.log2(F.greatest((F.col("_z") - F.col("_a")) / 1e6, F.lit(1.0)))).cast("int"))
    width = F.pow(F.lit(2.0), F.col("_level")) * 1e6
    spans = spans.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor((F.col("_z") - 1) / width))))
    levels = sorted(r["_level"] for r in spans.select("_level").distinct().collect())  # a number for each power of two
    times = points.select(*by, F.col(at).alias("_at")).where(F.col(at).isNotNull()).distinct().withColumn("_t", micros(F.col("_at")))
    times = times.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_slot", F.floor(F.col("_t") / width))
    covered = times.join(spans.hint("merge"), ["_level", "_slot", *by]).where((F.col("_a") <= F.col("_t")) & (F.col("_z") > F.col("_t")))
    best = covered.groupBy(*by, "_at").agg(F.max_by("_i", F.struct("_a", F.col("_i")[key])).alias("_i"))
    return points.join(best.withColumnRenamed("_at", at).hint("merge"), [*by, at]).select(*points.columns, "_i.*")
