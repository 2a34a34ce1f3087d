"""Sequences in ranges: the same rows however a table is cut, with all rows in one day, of one user, or at one time."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_operators import T0

from tidemark.operators import sessions


def rows_of(n, users, seed, span=80_000):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = None if rng.random() < 0.01 else T0 + timedelta(seconds=rng.randrange(span))
        d = rng.choice([None, 0.0, 5.0, 50.0, 300.0])
        e = None if s is None or d is None or rng.random() < 0.5 else s + timedelta(seconds=d)
        out.append((i, None if users == 1 else rng.randrange(users) or None, s, e, d, rng.choice(["a", "a", "a", "b", None]), rng.random() * 90, rng.random() < 0.15, rng.random() < 0.6))
    return out


SCHEMA = "id long, u int, s timestamp, e timestamp, d double, track string, score double, reset boolean, uses boolean"


def answers(df):
    """Everything that walks a sequence, each with a key and without one where that is allowed."""
    order = ["s", "id"]
    yield sessions.sessionize(df, ["u"], "s", "e", "d", order, 60.0).select("id", "session")
    yield sessions.spin_stats(df, ["u"], "s", "e", "d", order)
    for by in (["u"], []):
        yield sessions.neighbours(df, ["id", "d"], order, by).select("id", "prev", "next")
        yield sessions.confirm_runs(df, by, order, "track", F.col("track").isNotNull(), "score").select("id", "run_position", "accepted")
        yield sessions.cache_runs(df, by, order, F.col("reset"), F.col("uses")).select("id", "calls", "answer_group")
        yield sessions.cache_runs(df, by, order, F.col("reset"), F.col("uses"), 0).select("id", "calls", "answer_group")
        rows = sessions.stitch_runs(df.withColumn("e", F.col("s") + F.expr("INTERVAL 1 SECOND")), by, "score_id", "s", "e", "id", "d", "u")
        yield rows.withColumn("members", F.array_sort("members"))


@pytest.mark.parametrize("users, span", [(1, 80_000), (7, 80_000), (40, 3_000_000), (1, 3)])
def test_cuts_change_nothing(spark, monkeypatch, users, span):
    df = spark.createDataFrame(rows_of(900, users, users + span, span), SCHEMA).withColumn("score_id", F.floor(F.col("score") / 30)).repartition(4)
    assert sessions.slots(df, "s") is None
    whole = [sorted(map(repr, x.collect())) for x in answers(df)]
    monkeypatch.setattr(sessions, "SLOT_ROWS", 37)
    sizes = [r["count"] for r in df.groupBy(sessions.slots(df, "s")).count().collect()]
    assert max(sizes) < 400 if span == 3 else len(sizes) > 20 and max(sizes) < 80
    assert [sorted(map(repr, x.collect())) for x in answers(df)] == whole and sum(map(bool, whole)) >= 10


def test_slots_rise_with_numbers_and_dates(spark, monkeypatch):
    monkeypatch.setattr(sessions, "SLOT_ROWS", 50)
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), F.expr("date_add(date'2024-01-01', cast(id AS int))").alias("day"), F.expr("cast(timestamp_seconds(id * 9999) AS timestamp_ntz)").alias("t"))
    for c in ("x", "day", "t"):
        got = [r.n for r in df.orderBy(c).select(sessions.slots(df, c).alias("n")).collect()]
        assert got == sorted(got) and 15 <= len(set(got)) <= 20
