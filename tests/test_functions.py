from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import brands, text, timewin


def values(spark, rows, *columns):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [tuple(r) for r in df.select(*[c(F.col("x")) for c in columns]).collect()]


def test_keys(spark):
    rows = ["  Foo  ", "O'Brien", "'quoted'", None, "  ", "Straße ΣΑΣ"]
    got = [r[0] for r in values(spark, rows, text.normalize_token)]
    assert got == ["foo", "o'brien", "quoted", None, None, "Straße ΣΑΣ".casefold()]
    titles = ["Bedroom Posters (feat. Good Charlotte)", "Bedroom Posters _feat. Good Charlotte", "Can_t Stop", "Can’t  Stop", "Song (Somebody Remix)"]
    assert [r[0] for r in values(spark, titles, text.song_title_key)][:4] == ["bedroom posters", "bedroom posters", "cant stop", "cant stop"]
    assert values(spark, titles[2:4], text.display_key) == [("cant stop",), ("cant stop",)]


def test_track_ids_and_gates(spark):
    rows = ["refs/Oasis - Wonderwall (alt 2).mp3", "A_-_B.wav", "Title.flac", "Oasis - Wonderwall (MTV Unplugged).mp3"]
    got = [r[0].asDict() for r in values(spark, rows, text.split_track_id)]
    assert [(g["artist"], g["title"]) for g in got] == [("Oasis", "Wonderwall"), ("A", "B"), (None, "Title"), ("Oasis", "Wonderwall (MTV Unplugged)")]
    assert [r[0] for r in values(spark, ["", "Thanks for watching!", "two words", "this is long enough"], text.transcript_gate)] == ["empty", "hallucination", "short", None]


def test_display_preference(spark):
    pairs = [("LINKIN PARK", "linkin park"), ("Can_t Stop", "Can't Stop"), ("Adams Song", "Adam's Song"), ("ABC", "Abc"), ("One", "Two"), (None, "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(text.prefer_display(F.col("a"), F.col("b"))).collect()]
    assert got == ["linkin park", "Can't Stop", "Adam's Song", "Abc", "One", "x"]


def test_buckets_dates_brands(spark):
    df = spark.createDataFrame([(12.4,), (12.6,), (30.0,), (12.5,)], "v double")
    assert [r[0] for r in df.select(text.bucket_duration(F.col("v"))).collect()] == [10, 15, 30, 10]
    assert [str(r[0]) for r in values(spark, ["1995", "1995-10", "1995-02-30", "x"], timewin.partial_date)] == ["1995-01-01", "1995-10-01", "None", "None"]
    assert [r[0] for r in values(spark, ["home  depot", " A & B ", "AT&T", ""], brands.canonicalize_brand)] == ["The Home Depot", "A and B", "AT&T", None]
    assert [r[0] for r in values(spark, ["go to ethos.com", "call Big Lou", "google.com", None], brands.extract_brand)] == ["Ethos", "Big Lou", None, None]


def test_windows_and_spans(spark):
    rows = [(22.0,), (60.0,)]
    df = spark.createDataFrame(rows, "s double").select(F.lit(100).alias("sample_rate_hz"), (F.col("s") * 100).cast("long").alias("samples"), F.lit("2024-01-01").cast("timestamp").alias("capture_start"))
    assert timewin.sliding_windows(df).groupBy("samples").count().orderBy("samples").collect()[0][1] == 1
    assert timewin.sliding_windows(df).where("samples = 6000").count() == 5
    with pytest.raises(ValueError):
        timewin.sliding_windows(df, 20, 0)
    now = datetime(2024, 1, 2, tzinfo=UTC)
    assert timewin.parse_since("24h", now) == datetime(2024, 1, 1, tzinfo=UTC)
    with pytest.raises(ValueError):
        timewin.resolve_window(since="1h", from_="2024-01-01")


def test_text_similarities_are_those_of_the_columns(spark):
    from tidemark.functions import text

    texts = [None, "", "!?", "One two", "one TWO two", "it's Köln \u212aelvin \u0130x A1_b", "the the the end", "x " * 3000 + "y"]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    x, y = text.tokens(F.col("a")), text.tokens(F.col("b"))
    rows = pairs.select(text.jaccard(x, y).alias("j"), text.cosine(x, y).alias("c"), text.text_similarities(F.col("a"), F.col("b")).alias("s")).collect()
    assert len(rows) == 64 and all(r.j == r.s.jaccard and abs(r.c - r.s.cosine) < 1e-15 for r in rows)
