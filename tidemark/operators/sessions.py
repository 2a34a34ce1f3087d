"""Sequences: sessions by gap, islands, neighbours, confirmation and cache runs."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.timewin import gap_seconds, plus_seconds, span_seconds


def end_of(start: Column, end: Column, duration: Column) -> Column:
    """When a segment is over: its end, else start and a positive duration, else its start."""
    return F.coalesce(end, F.when(duration > 0, plus_seconds(start, duration)), start)


def _same(left: list[str], right: list[str]) -> Column:
    return functools.reduce(lambda x, y: x & y, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)))


#: Rows of a range of a long sequence, about, and ranges of a table, at most.
SLOT_ROWS, MOST_SLOTS = 250_000, 10_000


def slots(df: DataFrame, at: str) -> Column | None:
    """A number that rises with column ``at`` (times or numbers, null first), of ranges of about SLOT_ROWS rows each; None if one will do.

    The bounds are approximate quantiles, so ranges have about as many rows however these lie in time. Rows with the
    same value are in one range. The driver sees the count and the bounds; a row finds its range by binary search.
    """
    kind, value = dict(df.dtypes)[at], F.col(at)
    if kind == "timestamp":
        value = F.unix_micros(value)
    elif kind in ("timestamp_ntz", "date"):
        value = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), value.cast("timestamp_ntz"))
    value = value.cast("double")
    ranges = min(MOST_SLOTS, -(-df.select(at).count() // SLOT_ROWS))
    if ranges < 2:
        return None
    found = df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges))).first()[0]
    bounds = F.split(F.lit(",".join(map(repr, sorted(set(found or []))))), ",").cast("array<double>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(ranges.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(bounds, n + step - 1) <= value, n + step).otherwise(n))


def _carried(ends: DataFrame, by: list[str], joins: Column, breaks: Column, tail: Column, name: str) -> DataFrame:
    """``ends``, a row for each range, with how much of a run comes into the range from those before it.

    A run comes in where ``joins``; it ends inside where ``breaks``, and then ``tail`` is what the range's last run has
    of it, otherwise the range adds all of ``tail``. Sums of tails since the last break carry over any number of ranges.
    """
    order = W.partitionBy(*by).orderBy("_slot")
    rows = ends.withColumn("_joins", F.coalesce(joins, F.lit(False))).withColumn("_tail", tail)
    rows = rows.withColumn("_run_of", F.sum(F.when(breaks | ~F.col("_joins"), 1).otherwise(0)).over(order))
    rows = rows.withColumn("_out", F.sum("_tail").over(W.partitionBy(*by, "_run_of").orderBy("_slot")))
    return rows.withColumn(name, F.when(F.col("_joins"), F.coalesce(F.lag("_out").over(order), F.lit(0))).otherwise(0)).drop("_joins", "_tail", "_run_of", "_out")


def _placed(rows: DataFrame, ends: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """``rows`` with ``columns`` of their range's row of ``ends``."""
    place = [*by, "_slot"]
    ends = ends.select(*[F.col(c).alias(f"_of{i}") for i, c in enumerate(place)], *columns)
    return rows.join(ends, _same(place, [f"_of{i}" for i in range(len(place))])).drop(*[f"_of{i}" for i in range(len(place))])


def sessionize(df: DataFrame, keys: list[str], start: str, end: str, duration: str, order: list[str], gap: float) -> DataFrame:
    """Adds ``session``: a new one where the gap since the *previous* row's end exceeds ``gap`` seconds.

    Not since the latest end so far: a short row inside a long one resets the end, so session_window
    would give other sessions. Nulls in keys form groups of their own. A key may hold very many rows: a large
    table is ordered in ranges (``slots``) of the first column of ``order``, and one row for each key and range tells
    what goes on from the ranges before.
    """
    slot = slots(df, order[0])
    cut = df.withColumn("_end", end_of(F.col(start), F.col(end), F.col(duration)))
    if slot is None:
        w = W.partitionBy(*keys).orderBy(*order)
        prev = F.lag("_end").over(w)
        new = F.when(F.row_number().over(w) == 1, 1).when(gap_seconds(prev, F.col(start)) > gap, 1).otherwise(0)
        return cut.withColumn("_new", new).select(*df.columns, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("session"))
    cut = cut.withColumn("_slot", slot)
    place = [*keys, "_slot"]
    w = W.partitionBy(*place).orderBy(*order)
    prev = F.lag("_end").over(w)
    cut = cut.withColumn("_first", F.row_number().over(w) == 1).withColumn("_new", F.when(~F.col("_first") & (gap_seconds(prev, F.col(start)) > gap), 1).otherwise(0))
    by_order = F.struct(*order)
    ends = cut.groupBy(*place).agg(F.min_by(start, by_order).alias("_begin"), F.max_by("_end", by_order).alias("_last"), F.sum("_new").alias("_news"))
    across = W.partitionBy(*keys).orderBy("_slot")
    before = F.lag("_last").over(across)
    ends = ends.withColumn("_nr", F.row_number().over(across))
    ends = ends.withColumn("_open", F.when((F.col("_nr") == 1) | (gap_seconds(before, F.col("_begin")) > gap), 1).otherwise(0))
    ahead = F.coalesce(F.sum(F.col("_open") + F.col("_news")).over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = ends.withColumn("_ahead", ahead + F.col("_open")).drop("_news")
    rows = cut.withColumn("_own", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return _placed(rows, ends, keys, "_ahead").select(*df.columns, (F.col("_ahead") + F.col("_own")).alias("session"))


def exact_sum(c: Column) -> Column:
    """The sum of doubles as that of their decimals, to 15 places: no order of rows moves it across a threshold.

    Rows that no decimal holds (NaN, infinities, 1e23 and beyond) leave the plain sum.
    """
    told = c.try_cast("decimal(38,15)")
    odd = F.count_if(c.isNotNull() & told.isNull()) > 0
    return F.when(odd, F.sum(c)).otherwise(F.coalesce(F.try_sum(told).cast("double"), F.sum(c)))


def _told_in_order(out: DataFrame, cut: DataFrame, by: list[str], value: Column, order: list[str], limit: float) -> DataFrame:
    """``out`` with play_seconds as doubles added in order, where rounding may decide whether they reach ``limit``.

    Any order of n additions is within n roundings of the sum of sizes (``_mass``) of the exact sum, so elsewhere both
    are on the same side; only rows of plays beside the limit are walked, as running sums.
    """
    beside = F.abs(F.col("play_seconds") - limit) <= F.col("segments") * F.col("_mass") * 2.3e-16
    of = [f"_of{i}" for i in range(len(by))]
    near = out.where(beside).select(*[F.col(c).alias(o) for c, o in zip(by, of, strict=True)])
    rows = cut.withColumn("_value", value).join(near, _same(by, of), "left_semi")
    rows = rows.withColumn("_sum", F.sum("_value").over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    told = rows.groupBy(*[F.col(c).alias(o) for c, o in zip(by, of, strict=True)]).agg(F.max_by("_sum", F.struct(*order)).alias("_told"))
    return out.join(told, _same(by, of), "left").withColumn("play_seconds", F.coalesce("_told", "play_seconds")).drop("_told", *of)


def plays(df: DataFrame, keys: list[str], start: str, end: str, duration: str, order: list[str], gap: float = 60.0, promo_below: float = 90.0, in_order: bool = False) -> DataFrame:
    """One row a play: keys, play_start, play_end (the last row's that has one), play_seconds, segments, is_promo.

    Seconds are summed exactly; with ``in_order``, those beside ``promo_below`` are what adding doubles in order of rows gives.
    """
    cut = sessionize(df, keys, start, end, duration, order, gap)
    last = F.max_by(F.col(end), F.when(F.col(end).isNotNull(), F.struct(*order)))
    value = F.coalesce(F.col(duration), F.lit(0.0))
    out = cut.groupBy(*keys, "session").agg(F.min(start).alias("play_start"), last.alias("play_end"), exact_sum(value).alias("play_seconds"), F.count(F.lit(1)).alias("segments"), F.sum(F.abs(value)).alias("_mass"))
    if in_order:
        out = _told_in_order(out, cut, [*keys, "session"], value, order, promo_below)
    return out.drop("_mass").withColumn("is_promo", F.col("play_seconds") < promo_below)


def spin_stats(df: DataFrame, keys: list[str], start: str, end: str, duration: str, order: list[str], gap: float = 60.0, promo_below: float = 90.0, in_order: bool = False) -> DataFrame:
    """keys with spins, promo_spins, full_spins, segments, airtime and full_airtime.

    Plays without any duration are no spins, but a key that has nothing else keeps its row with 0 spins.
    """
    p = plays(df, keys, start, end, duration, order, gap, promo_below, in_order)
    real, full = F.col("play_seconds") > 0, F.col("play_seconds") >= promo_below
    return p.groupBy(*keys).agg(
        F.count_if(real).alias("spins"),
        F.count_if(real & ~full).alias("promo_spins"),
        F.count_if(full).alias("full_spins"),
        F.sum("segments").alias("segments"),
        exact_sum(F.col("play_seconds")).alias("airtime"),
        exact_sum(F.when(full, F.col("play_seconds")).otherwise(0.0)).alias("full_airtime"),
    )


def mode_first_seen(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The most frequent value of each key; of equals the one seen first."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_first"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_n"), "_first"))
    return counts.withColumn("_rank", rank).where("_rank = 1").select(*keys, value)


def neighbours(df: DataFrame, columns: list[str], order: list[str], by: list[str], slot: Column | str | None = "ask") -> DataFrame:
    """Adds structs ``prev`` and ``next`` of ``columns`` in order within ``by``, which may be empty.

    A large table is ordered in ranges (``slots`` of the first column of ``order``, unless ``slot`` has them already): the
    first and last row of each, a small table, give the neighbours across its borders.
    """
    own = F.struct(*columns)
    slot = slots(df, order[0]) if isinstance(slot, str) else slot
    if slot is None:
        w = W.partitionBy(*by).orderBy(*order)
        return df.withColumn("prev", F.lag(own).over(w)).withColumn("next", F.lead(own).over(w))
    cut = df.withColumn("_slot", slot)
    w = W.partitionBy(*by, "_slot").orderBy(*order)
    ends = cut.groupBy(*by, "_slot").agg(F.min_by(own, F.struct(*order)).alias("_first"), F.max_by(own, F.struct(*order)).alias("_last"))
    across = W.partitionBy(*by).orderBy("_slot")
    ends = ends.withColumn("_before", F.lag("_last").over(across)).withColumn("_after", F.lead("_first").over(across))
    out = _placed(cut.withColumn("prev", F.lag(own).over(w)).withColumn("next", F.lead(own).over(w)), ends, by, "_before", "_after")
    return out.select(*df.columns, F.coalesce("prev", "_before").alias("prev"), F.coalesce("next", "_after").alias("next"))


def islands(df: DataFrame, by: list[str], order: list[str], same: Column, name: str = "island") -> DataFrame:
    """Adds a running number of the maximal runs in which ``same`` (with the row before) holds; null is no."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def numbered_islands(df: DataFrame, by: list[str], order: list[str], same: Column, slot: Column | None, name: str = "island") -> DataFrame:
    """islands() over ranges of rows (``slots``; None: one), whose counts, a row each, are added up; ``by`` may be empty."""
    if slot is None:
        return islands(df, by, order, same, name)
    w = W.partitionBy(*by, "_slot").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("_slot", slot).withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_own", F.sum("_new").over(w))
    ahead = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = rows.groupBy(*by, "_slot").agg(F.sum("_new").alias("_n")).withColumn("_ahead", ahead)
    return _placed(rows, ends, by, "_ahead").select(*df.columns, (F.col("_ahead") + F.col("_own")).alias(name))


def stitch_runs(df: DataFrame, by: list[str], song: str, start: str, end: str, id_: str, confidence: str, run: str, most: float = 2.0) -> DataFrame:
    """Runs of one song whose rows follow each other within 0 to ``most`` seconds, as one row of several.

    Rows with a song and an end are walked in order of time, all of them where ``by`` is empty: another
    song in between ends a run, as does overlap. survivor is the earliest row's id, the end is the last
    row's, not the latest.
    """
    rows = df.where(F.col(song).isNotNull() & F.col(end).isNotNull())
    slot = slots(rows, start)
    rows = neighbours(rows, [song, end], [start, id_], by, slot)
    same = (F.col("prev")[song] == F.col(song)) & span_seconds(F.col("prev")[end], F.col(start)).between(0, most)
    rows = numbered_islands(rows, by, [start, id_], F.coalesce(same, F.lit(False)), slot)
    at = F.struct(start, id_)
    return (
        rows.groupBy(*by, "island", song)
        .agg(F.min_by(id_, at).alias("survivor"), F.min(start).alias("start"), F.max_by(end, at).alias("end"), F.max(confidence).alias("confidence"), F.collect_set(id_).alias("members"), (F.count_distinct(run) > 1).alias("cross_run"))
        .where(F.size("members") > 1)
        .drop("island")
    )


def confirm_runs(df: DataFrame, by: list[str], order: list[str], track: str, matched: Column, score: str, strong: float = 60.0, repeats: int = 3, slot: Column | str | None = "ask") -> DataFrame:
    """Adds ``run_position`` and ``accepted``: a match counts from its second in a row on, a weak one from a later.

    A stream may hold very many rows: a large table is cut into ranges (``slots``) anywhere, and a run that goes on
    across their borders counts on.
    """
    slot = slots(df, order[0]) if isinstance(slot, str) else slot
    rows = df.withColumn("_track", F.when(matched, F.col(track))).withColumn("_slot", F.lit(0) if slot is None else slot)
    place = [*by, "_slot"]
    rows = rows.withColumn("_same", F.lag("_track").over(W.partitionBy(*place).orderBy(*order)) == F.col("_track"))
    rows = islands(rows, place, order, F.col("_same"), "_island")
    rows = rows.withColumn("_position", F.row_number().over(W.partitionBy(*place, "_island").orderBy(*order)))
    if slot is not None:
        at = F.struct(*order)
        ends = rows.groupBy(*place).agg(F.min_by("_track", at).alias("_first"), F.max_by("_track", at).alias("_last"), F.max_by("_position", at).alias("_held"), F.max("_island").alias("_islands"))
        goes_on = F.lag("_last").over(W.partitionBy(*by).orderBy("_slot")) == F.col("_first")
        ends = _carried(ends, by, goes_on, F.col("_islands") > 1, F.col("_held"), "_more")
        rows = _placed(rows, ends, by, "_more").withColumn("_position", F.col("_position") + F.when(F.col("_island") == 1, F.col("_more")).otherwise(0)).drop("_more")
    need = F.when(F.coalesce(F.col(score), F.lit(0.0)) >= strong, 2).otherwise(max(2, repeats))
    rows = rows.withColumn("run_position", F.when(F.col("_track").isNotNull(), F.col("_position").cast("int")))
    return rows.withColumn("accepted", F.coalesce(F.col("run_position") >= need, F.lit(False))).drop("_same", "_track", "_island", "_slot", "_position")


def cache_runs(df: DataFrame, by: list[str], order: list[str], reset: Column, uses: Column, every: int = 4, slot: Column | str | None = "ask") -> DataFrame:
    """Adds ``calls``: of the rows that use an external answer, those that ask for it anew.

    A reset ends a run; in a run every ``every``-th use asks, the others take ``answer_group``'s first answer.
    A large table is cut into ranges (``slots``) anywhere: resets and uses before a range are carried into it.
    """
    slot = slots(df, order[0]) if isinstance(slot, str) else slot
    rows = df.withColumn("_uses", F.coalesce(uses, F.lit(False))).withColumn("_slot", F.lit(0) if slot is None else slot)
    place = [*by, "_slot"]
    w = W.partitionBy(*place).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum(F.when(reset, 1).otherwise(0)).over(w))
    rows = rows.withColumn("_place", F.row_number().over(W.partitionBy(*place, "_run", "_uses").orderBy(*order)) - 1)
    if slot is not None:
        ends = rows.groupBy(*place, "_run").agg(F.count_if("_uses").alias("_used")).groupBy(*place).agg(F.max("_run").alias("_resets"), F.max_by("_used", "_run").alias("_used"))
        ends = ends.withColumn("_ahead", F.coalesce(F.sum("_resets").over(W.partitionBy(*by).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        ends = _carried(ends, by, F.lit(True), F.col("_resets") > 0, F.col("_used"), "_more")
        rows = _placed(rows, ends, by, "_ahead", "_more").withColumn("_place", F.col("_place") + F.when(F.col("_run") == 0, F.col("_more")).otherwise(0))
        rows = rows.withColumn("_run", F.col("_run") + F.col("_ahead")).drop("_ahead", "_more")
    rows = rows.withColumn("_place", F.when(F.col("_uses"), F.col("_place")))
    group = F.concat_ws("-", F.col("_run"), F.floor(F.col("_place") / max(every, 1)) if every > 0 else F.lit(0))
    calls = F.coalesce((F.col("_place") % every == 0) if every > 0 else (F.col("_place") == 0), F.lit(False))
    return rows.withColumn("calls", calls).withColumn("answer_group", F.when(F.col("_uses"), group)).drop("_uses", "_run", "_place", "_slot")
