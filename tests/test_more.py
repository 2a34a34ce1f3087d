"""Operators that no query runs: as-of edges, sessions across days, ids, upserts, promotions, speech, streams, commands."""

import io
import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import T0, at, event, make

from tidemark import cli
from tidemark.functions import text, timewin
from tidemark.operators import funnel, repair, reports, resolve, sessions, speech
from tidemark.plans import render
from tidemark.schemas import Tables
from tidemark.sources import readers, writers


def test_as_of_broadcasts_nothing(spark):
    spans = spark.range(50).select("id", F.timestamp_seconds(F.col("id") * 10).alias("s"), F.timestamp_seconds(F.col("id") * 10 + 15).alias("e"))
    points = spark.range(50).select(F.col("id").alias("p"), F.timestamp_seconds(F.col("id") * 7).alias("at"))
    got = timewin.as_of(points, spans, "at", "s", "e", "id")
    assert got.count() == 50 and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_as_of(spark):
    rng = random.Random(7)
    spans = [(i, at(s := rng.randrange(5000)), None if i % 5 == 0 else at(s + rng.choice([0, 1, 7, 300, 4000]))) for i in range(120)]
    points = [(i, at(rng.randrange(6000))) for i in range(200)] + [(1, None)]
    points += points[:5]
    got = sorted((r.p, r.at, r.id) for r in timewin.as_of(spark.createDataFrame(points, "p long, at timestamp"), spark.createDataFrame(spans, "id long, s timestamp, e timestamp"), "at", "s", "e", "id").collect())
    best = [(p, t, max((x for x in spans if x[2] and t and x[1] <= t < x[2]), key=lambda x: (x[1], x[0]), default=None)) for p, t in points]
    assert got == sorted((p, t, x[0]) for p, t, x in best if x) and len(got) > 50
    none = spark.createDataFrame([], "id long, s timestamp, e timestamp")
    assert timewin.as_of(spark.createDataFrame(points, "p long, at timestamp"), none, "at", "s", "e", "id").count() == 0


def test_sessions_across_days_and_null_keys(spark):
    rng = random.Random(2)
    rows = [(i, None if i % 3 else i % 2, T0 + timedelta(hours=rng.randrange(200)), rng.choice([None, 30.0, 7200.0, 90_000.0])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k int, s timestamp, d double").withColumn("e", F.lit(None).cast("timestamp"))
    got = {r.id: r.session for r in sessions.sessionize(df, ["k"], "s", "e", "d", ["s", "id"], 3600.0).collect()}
    for k in (None, 0, 1):
        prev, n = None, 0
        for i, _, s, d in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0])):
            n += prev is None or (s - prev).total_seconds() > 3600
            assert got[i] == n
            prev = s + timedelta(seconds=d or 0)


def test_stitch_walks_all_songs_in_order(spark):
    rows = [event(1, 0, 10, song_id=7), event(2, 10, 10, song_id=8), event(3, 20, 10, song_id=7), event(4, 30, 10, song_id=7)]
    rows += [event(5, 86_390, 10, song_id=9), event(6, 86_400, 10, song_id=9), event(7, 86_410, 10, song_id=9)]
    got = {r.survivor: (sorted(r.members), r.end) for r in repair.plan_stitch(make(spark, events=rows)).collect()}
    assert got == {3: ([3, 4], at(40)), 5: ([5, 6, 7], at(86_420))}


def test_ids_follow_each_other(spark):
    t = make(spark, brands=[{"id": 41, "canonical_name": "Old", "aliases": []}])
    names = ["Zeta", "alpha", "Old", "Beta", "Bravo", None, "", "Beta"]
    got = sorted((r.id, r.canonical_name) for r in repair.upsert_brands(t, spark.createDataFrame([(n,) for n in names], "name string"), T0).brands.collect())
    assert got == [(41, "Old"), (42, "Beta"), (43, "Bravo"), (44, "Zeta"), (45, "alpha")]
    segments = [(at(s), at(s + 5), "DJ", None, None, "Old" if s else None, None, None, None, None) for s in (200_000, 0, 86_000)]
    from tidemark.operators.reducer import SEGMENT

    more = repair.append_segments(t.having(events=make(spark, events=[event(9, 0, 1)]).events), spark.createDataFrame(segments, SEGMENT), 3, T0)
    assert [(r.id, r.timestamp_start, r.duration, r.brand_id, r.capture_run_id) for r in more.events.where("id > 9").orderBy("id").collect()] == [(10, at(0), 5.0, None, 3), (11, at(86_000), 5.0, 41, 3), (12, at(200_000), 5.0, 41, 3)]


def test_runs_and_mentions(spark):
    t = make(spark, brands=[{"id": 1, "canonical_name": "Shop", "aliases": []}], events=[event(5, 0, 100, "DJ"), event(6, 50, 10, "DJ")])
    new = spark.createDataFrame([("r1", T0), ("r1", T0), ("r2", T0)], "run_id string, started_utc timestamp")
    for c, k in (("ended_utc", "timestamp"), ("pipeline_version", "string"), ("host", "string"), ("notes", "string"), ("created_at", "timestamp")):
        new = new.withColumn(c, F.lit(None).cast(k))
    t = repair.open_runs(repair.open_runs(t, new), new)
    t = repair.close_runs(t, spark.createDataFrame([("r2", at(9), "done")], "run_id string, ended_utc timestamp, notes string"))
    assert [(r.id, r.run_id, r.ended_utc, r.notes) for r in t.capture_runs.orderBy("id").collect()] == [(1, "r1", None, None), (2, "r2", at(9), "done")]
    said = spark.createDataFrame([("shop", "tag", at(55)), ("Shop", "tag", at(55)), ("Shop", "tag", at(5000)), ("nobody", "tag", at(5))], "name string, mention_type string, heard_utc timestamp")
    t = t.having(brands=t.brands.withColumn("canonical_name", F.lit("Shop")))
    got = repair.attach_mentions(t, said.where("name <> 'shop'").unionAll(said.where("name = 'Shop' and heard_utc < timestamp'2024-01-01 00:10:00'"))).mentions
    assert sorted((r.id, r.segment_id, r.brand_id) for r in got.collect()) == [(1, 5, 2), (2, 6, 1), (3, 6, 1)]


def test_songs_upsert_promote_enrich(spark):
    t = make(spark, songs=[{"id": 1, "artist": "the band", "title": "Song", "source": "shazam"}, {"id": 2, "artist": "Listed", "title": "Known", "source": "shazam"}, {"id": 3, "artist": "A", "title": "B", "source": "audfprint", "release_date": "1999"}], events=[event(1, 0, 5, song_id=1), event(2, 9, 5, song_id=3)])
    heard = spark.createDataFrame([(1, "The Band", "Song (feat. X)", "trk", "audfprint"), (2, "New", "One", None, "shazam")], "seq long, artist string, title string, audfprint_track_id string, source string")
    songs = {r.id: r for r in repair.upsert_songs(t, heard, T0).songs.collect()}
    assert len(songs) == 4 and (songs[1].audfprint_track_id, songs[1].source) == ("trk", "audfprint") and (songs[4].artist, songs[4].first_seen_utc) == ("New", T0)
    asked = spark.createDataFrame([(0, 1), (1, 99), (2, 3), (3, 2), (4, 1)], "at int, song_id long")
    plan = repair.plan_promotions(t, asked, spark.createDataFrame([("listed", "known")], "artist string, title string"))
    assert [r.reason for r in plan.orderBy("at").collect()] == [None, "not found", "source", "already in tracklist", "duplicate in this call"]
    found = spark.createDataFrame([(1, "2001-05", ["2000", "bad"]), (3, "1990", [])], "song_id long, first_release string, release_dates array<string>")
    after, told = repair.enrich_releases(t, found)
    assert tuple(told.first()) == (2, 1, 1, 0) and {r.id: r.release_date for r in after.songs.collect()}[1] == "2000-01-01"


def test_resolved_ads_are_kept(spark):
    said = "buy our fine tires at the big shop on main street"
    t = make(spark, brands=[{"id": 4, "canonical_name": "Shop", "aliases": []}], commercials=[{"id": 30, "brand_id": 4, "duration_bucket_seconds": 20, "minhash_hex": "00" * 1024, "reference_transcript": said, "play_count": 2}])
    rows = [(1, "Shop", said, 20.0), (2, "Shop", "something else entirely that nobody said before today", 20.0), (3, "Shop", "something else entirely that nobody said before today", 20.0), (4, None, said, 20.0)]
    heard = spark.createDataFrame(rows, "seq long, brand string, transcript string, duration_seconds double").withColumn("key_phrases", F.array().cast("array<string>"))
    known = t.commercials.select(F.col("id").alias("ad"), F.lit("Shop").alias("brand"), F.col("duration_bucket_seconds").alias("bucket"), "minhash_hex", F.col("reference_transcript").alias("transcript"))
    after, told = repair.store_resolved(t, resolve.resolve_commercials(heard, known), T0)
    assert sorted((r.id, r.brand_id, r.play_count) for r in after.commercials.collect()) == [(30, 4, 3), (31, 4, 2)]
    assert sorted(tuple(r) for r in told.collect()) == [(1, 30), (2, 31), (3, 31)]


def test_reports_of_repairs_and_progress(spark):
    items = spark.createDataFrame([("A", "url", 0.6), ("A", "phrase", 0.9), ("B", "url", 0.7)], "brand_name string, source string, similarity double")
    assert [tuple(r) for r in repair.repair_report(items, source="source", similarity="similarity").collect()] == [("A", 2, "phrase+url", 0.6, 0.9), ("B", 1, "url", 0.7, 0.7)]
    rows = spark.createDataFrame([((("SONG",),),), (None,), ((("SONG",),),)], "segment_input struct<key: struct<category: string>>")
    got = {r.category: r.windows for r in repair.progress(rows).collect()}
    assert (got["SONG"], got["UNKNOWN"], got["DJ"]) == (2, 1, 0) and len(got) == 6


def test_speech_tier(spark):
    loud, quiet = np.full(100, 2000, "<i2").tobytes(), np.full(100, 10, "<i2").tobytes()
    df = spark.createDataFrame([(1, loud), (2, quiet), (3, loud), (4, loud), (5, loud), (6, loud)], "w long, pcm binary")
    words = {1: "come to smart & final for the sale", 3: "thanks for watching", 4: "four whole words here", 5: None, 6: "just talking on the air now"}
    answers = {1: {"class": "COMMERCIAL", "brand": "smart & final", "confidence": 0.8}, 4: {"class": "NOISE"}, 6: {"class": "DJ"}}
    asked = []

    def hear(rows):
        asked.append(sorted(r.w for r in rows.select("w").collect()))
        return spark.createDataFrame(list(words.items()), "w long, transcript string")

    def judge(rows):
        asked.append(sorted(r.w for r in rows.select("w").collect()))
        return spark.createDataFrame([(k, json.dumps(v)) for k, v in answers.items()], "w long, answer_json string")

    got = {r.w: r.sp for r in speech.speech_tier(df, "w", hear, judge).collect()}
    assert asked == [[1, 3, 4, 5, 6], [1, 4, 6]]
    assert {w: s.status for w, s in got.items()} == {1: "ok", 2: "skipped", 3: "skipped", 4: "error", 5: "error", 6: "ok"}
    assert (got[1].category, got[1].brand, got[1].confidence) == ("COMMERCIAL", "Smart and Final", 0.8) and got[3].message == "hallucination" and "rms 10.0" in got[2].message


def test_small_operators(spark):
    t = make(spark, events=[event(1, 0, 10), event(2, 20, 30)])
    run = repair.add_runs(t, T0)
    assert [(r.run_id, r.started_utc, r.ended_utc) for r in run.capture_runs.collect()] == [("legacy", at(0), at(50))] and run.events.where("capture_run_id is null").count() == 0
    old = spark.createDataFrame([(1, "MUSIC", at(0), at(60), None), (2, "AD", at(60), at(90), " Shop "), (3, "NOISE", at(90), at(95), None)], "id long, category string, timestamp_start timestamp, timestamp_end timestamp, brand_name string").withColumn("duration", F.lit(None).cast("double"))
    after, told = repair.migrate_first(Tables.empty(spark), old, T0)
    assert tuple(told.first()) == (3, 2, 1) and [(r.id, r.category, r.duration, r.brand_id) for r in after.events.orderBy("id").collect()] == [(1, "SONG", 60.0, None), (2, "COMMERCIAL", 30.0, 1)]
    lines = spark.createDataFrame([(0, "Matched q1 5 s as a.mp3 at 2 s with 40 of 90"), (1, "Matched q1 5 s as b.mp3 at 2 s with 41 of 90"), (2, "NOMATCH q2"), (3, "Matched q1 5 s as c.mp3 at 2 s with 41 of 90")], "at int, line string")
    best = resolve.best_candidate(resolve.fingerprint_candidates(lines)).collect()
    assert [(r.query, r.track, r.score) for r in best] == [("q1", "b.mp3", 41)]
    assert reports.captured_seconds(spark.createDataFrame([("12.9",), ("x",), (None,), ("3",)], "duration_seconds string")).first().seconds == 15
    assert tuple(reports.recall(spark.createDataFrame([("A_b", "a B"), ("x", "y"), ("z", None)], "truth string, found string")).first())[:2] == (1, 3)
    frames = spark.createDataFrame([(1, [0.9, 0.2]), (1, [0.7, 0.0]), (2, [0.0, 0.0])], "window_id int, scores array<double>").withColumn("groups", F.array(F.lit("music"), F.lit("speech"))).withColumn("names", F.array(F.lit("Music"), F.lit("Speech")))
    rolled = {r.window_id: r for r in reports.class_rollup(frames).collect()}
    assert rolled[1].music_prob == pytest.approx(0.8 / 0.9) and rolled[2].other_prob == pytest.approx(1 / 3) and rolled[1].top_classes[0].name == "Music"
    names = spark.createDataFrame([("Drum roll", "music"), ("Speech synthesizer", "speech"), ("Dog", "other")], "n string, g string")
    assert all(r.g == r.x for r in names.select("g", funnel.class_group(F.col("n")).alias("x")).collect())
    one = spark.range(1)
    shown = one.select(text.filename_stem(F.lit(" a/b:c  d. ")), text.label_key(F.lit("Big_Deal ")), text.excerpt(F.lit("abcdef"), 4), timewin.format_seconds(F.lit(3725.0)), timewin.iso_ms(F.lit(T0)), text.cache_key(F.lit(" A  b ")), text.query_escape(F.lit("a+b"))).first()
    assert tuple(shown) == ("a_b_c d", "big deal", "abc…", "1h02m", "2024-01-01T00:00:00.000Z", "a b", "a\\+b")
    assert one.select(timewin.earliest_date(F.lit("2001-02"), F.array(F.lit("2001"), F.lit("bad")))).first()[0].isoformat() == "2001-01-01"


def test_models_are_asked_once(spark, tmp_path):
    df = spark.createDataFrame([("A b",), ("a  B",), ("c",)], "t string").repartition(1)
    got = readers.call_model(df, text.cache_key(F.col("t")), lambda xs: [x.upper() for x in xs], "t").collect()
    assert len({r.answer_json for r in got if r.t != "c"}) == 1 and {r.answer_json for r in got if r.t == "c"} == {"C"}
    writers.write_json_lines(spark.createDataFrame([(1, None)], "a int, b string").repartition(1), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"a":1,"b":null}'
    (tmp_path / "list.txt").write_text("x | y")
    assert writers.append_tracklist(str(tmp_path / "list.txt"), [("p", "q")], datetime(2024, 2, 3).date()) == 1
    assert (tmp_path / "list.txt").read_text().endswith("\n# 2024-02-03 promoted\np | q\n")


def test_cells():
    assert (render.spin_cell(2, 1), render.spin_cell(3, 0), render.promo_cell(0, ""), render.promo_cell(2, "30s")) == ("2 (+1)", "3", "-", "2 / 30s")
    assert (render.artist_title("A", "T"), render.artist_title(None, "T"), render.artist_title(None, None), render.promo_label("x", True)) == ("A - T", "T", "-", "x [promo]")


def test_segments_are_stored(spark, tmp_path):
    from tidemark.operators.reducer import SEGMENT
    from tidemark.streaming.segments import store_segments

    path = str(tmp_path / "db")
    make(spark, brands=[{"id": 8, "canonical_name": "Shop", "aliases": []}]).brands.write.parquet(f"{path}/brands")
    rows = [(at(s), at(s + 5), "COMMERCIAL", None, None, "Shop", None, None, None, None) for s in (0, 10)]
    spark.createDataFrame(rows, SEGMENT).repartition(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(SEGMENT).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        q = store_segments(live, path, str(tmp_path / "cp"), 3)
        q.processAllAvailable()
        q.stop()
    got = spark.read.parquet(f"{path}/events").collect()
    assert sorted((r.id & 0xFF, r.brand_id, r.duration, r.capture_run_id) for r in got) == [(1, 8, 5.0, 3), (2, 8, 5.0, 3)]


def test_commands(spark, tmp_path):
    def say(*words):
        out = io.StringIO()
        assert cli.main(["--tables", str(tmp_path / "db"), *words], spark, out) == 0
        return out.getvalue()

    say("db", "init")
    say("runs", "start", "r1")
    assert "r1" in say("runs", "list")
    songs = [{"id": 1, "artist": "A", "title": "T", "source": "shazam", "first_seen_utc": at(0)}, {"id": 2, "artist": "a", "title": "t", "source": "audfprint", "first_seen_utc": at(0)}]
    Tables.read(spark, str(tmp_path / "db")).having(songs=make(spark, songs=songs).songs, events=make(spark, events=[event(1, 0, 200, song_id=1)]).events).replace_at(str(tmp_path / "db"))
    window = ("--from", "2024-01-01T00:00:00Z", "--to", "2024-01-02T00:00:00Z")
    assert "SONG" in say("report", "summary", *window) and "200.0" in say("report", "songs", *window)
    assert "loser_id" in say("songs", "dedupe", *window) and Tables.read(spark, str(tmp_path / "db")).songs.count() == 2
    say("songs", "dedupe", "--apply", *window)
    assert [r.id for r in Tables.read(spark, str(tmp_path / "db")).songs.collect()] == [2]
    say("report", "dashboard", "--html", str(tmp_path / "d.html"), *window)
    say("report", "artist-plays", "--html", str(tmp_path / "p.html"), *window)
    assert "<h1>" in (tmp_path / "d.html").read_text() and "1 plays, 1 titles" in (tmp_path / "p.html").read_text()
    assert cli.main(["--tables", str(tmp_path / "db"), "report", "summary", "--to", "2024-01-01"], spark) == 2


def test_the_funnel_plans_once(spark, monkeypatch):
    """The plan is written before it is used: nothing that follows orders the windows again."""
    from tidemark.plans import queries

    seen, share = [], funnel.share_answers
    monkeypatch.setattr(funnel, "share_answers", lambda planned, *rest: seen.append(planned._jdf.queryExecution().executedPlan().toString()) or share(planned, *rest))
    assert queries.funnel_route(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert len(seen) == 1 and "Window" not in seen[0]
