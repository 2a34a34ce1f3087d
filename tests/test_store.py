"""Versions of the tables: commits that fail anywhere, two writers, migration, copies that are checked, maintenance in order."""

import io
import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from test_operators import T0, at, event, make

from tidemark import cli
from tidemark.functions import text
from tidemark.operators import maintenance, repair
from tidemark.schemas import Tables
from tidemark.sources import readers
from tidemark.sources.store import Conflict, Store, digest
from tidemark.streaming.progress import NAMES, Progress, observed


def names(store):
    return sorted(r.canonical_name for r in store.read().brands.collect())


def brand(t, spark, name):
    return repair.upsert_brands(t, spark.createDataFrame([(name,)], "name string"), T0)


def test_commit_writes_what_changed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    assert store.snapshot() is None and store.versions() == []
    first = store.commit(make(spark, events=[event(1, 0, 10)]), None)
    was = store.read(first)
    second = store.commit(brand(was, spark, "Acme"), first, was)
    assert (first.version, second.version) == (1, 2) and second.folders["events"] == first.folders["events"] and second.folders["brands"] != first.folders["brands"]
    assert names(store) == ["Acme"] and store.read(first).brands.count() == 0 and store.snapshot(7) is None
    gone = store.prune(1)
    assert gone == [first.folders["brands"]] and names(store) == ["Acme"] and store.versions() == [2] and store.read().events.count() == 1


def test_failure_at_each_step_leaves_a_readable_state(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "db"))
    store.commit(make(spark, events=[event(1, 0, 10)]), None)
    plain, publish = DataFrameWriter.parquet, Store._publish
    for step in range(8):
        left = [step]

        def parquet(self, path, *more, left=left, **named):
            if "/data/" in path:
                if not left[0]:
                    raise RuntimeError("lost")
                left[0] -= 1
            return plain(self, path, *more, **named)

        def broken(self, s, left=left):
            if left[0] == 0:
                raise RuntimeError("lost")
            publish(self, s)
            raise RuntimeError("lost after the rename")

        monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
        monkeypatch.setattr(Store, "_publish", broken)
        base = store.snapshot()
        t = brand(store.read(base), spark, "New").having(events=make(spark, events=[event(1, 0, 10), event(2, 10, 10)]).events)
        with pytest.raises(RuntimeError, match="lost"):
            store.commit(t, base)
        monkeypatch.setattr(DataFrameWriter, "parquet", plain)
        monkeypatch.setattr(Store, "_publish", publish)
        done = step == 7
        assert store.versions() == ([1, 2] if done else [1]) and store.read().events.count() == (2 if done else 1) and names(store) == (["New"] if done else [])


def test_of_two_writers_one_is_refused(spark, tmp_path):
    store, other = Store(spark, str(tmp_path / "db")), Store(spark, str(tmp_path / "db"))
    store.commit(make(spark), None)
    base = store.snapshot()
    store.commit(brand(store.read(base), spark, "One"), base)
    with pytest.raises(Conflict):
        other.commit(brand(other.read(base), spark, "Two"), base)
    assert names(store) == ["One"] and not list(Path(tmp_path / "db" / "_versions").glob(".draft*.json"))
    tried = []

    def late(t):
        tried.append(1)
        if len(tried) == 1:
            other.change(lambda u: brand(u, spark, "First"))
        return brand(t, spark, "Second")

    store.change(late)
    assert len(tried) == 2 and names(store) == ["First", "One", "Second"] and store.versions() == [1, 2, 3, 4]


def test_plain_tables_and_migration(spark, tmp_path):
    make(spark, events=[event(1, 0, 10), event(2, 20, 30)]).write(str(tmp_path / "plain"))
    assert Tables.read(spark, str(tmp_path / "plain")).events.count() == 2
    Tables.read(spark, str(tmp_path / "plain")).replace_at(str(tmp_path / "plain"))
    assert Store(spark, str(tmp_path / "plain")).versions() == [1]
    # schema 2 has neither runs nor release dates
    old = Store(spark, str(tmp_path / "old"))
    t = make(spark, events=[event(1, 0, 10), event(2, 20, 30)], songs=[{"id": 1, "artist": "A", "title": "T", "source": "manual"}])
    s = old.commit(t.having(events=t.events.drop("capture_run_id"), songs=t.songs.drop("release_date")), None, schema=2)
    folders = {k: v for k, v in s.folders.items() if k != "capture_runs"}
    manifest = tmp_path / "old" / "_versions" / "0000000001.json"
    (tmp_path / "old" / "_versions" / ".0000000001.json.crc").unlink(missing_ok=True)
    manifest.write_text(json.dumps({"schema": 2, "folders": folders}))
    last = old.migrate(T0)
    assert (last.version, last.schema) == (3, 4) and old.snapshot(2).schema == 3
    after = old.read()
    assert [(r.started_utc, r.ended_utc) for r in after.capture_runs.collect()] == [(at(0), at(50))] and after.events.where("capture_run_id is null").count() == 0 and after.songs.first().release_date is None
    assert old.migrate(T0).version == 3
    with pytest.raises(ValueError, match="schema 9"):
        strange = Store(spark, str(tmp_path / "strange"))
        strange.commit(t, None, schema=9)
        strange.migrate(T0)


def shop(spark):
    said = "visit ethos.com for cover of your life today"
    ads = [event(1, 0, 20, "COMMERCIAL", transcript_excerpt=said), event(2, 900, 20, "COMMERCIAL", transcript_excerpt=said + " now"), event(3, 1800, 200, "COMMERCIAL", transcript_excerpt=said), event(4, 2400, 20, "COMMERCIAL", transcript_excerpt="words that name nobody at all here"), event(5, 3000, 100, song_id=1), event(6, 3101, 90, song_id=2)]
    songs = [{"id": 1, "artist": "A", "title": "T", "source": "shazam"}, {"id": 2, "artist": "a", "title": "t", "source": "audfprint"}]
    return make(spark, events=ads, songs=songs)


def test_backfill_finds_ads(spark):
    t = shop(spark)
    assert {(r.event_id, r.source) for r in repair.plan_backfill(t).collect()} == {(1, "deterministic"), (2, "deterministic"), (3, "deterministic")}
    asked = []

    def model(rows):
        asked.extend(r.event_id for r in rows.collect())
        return spark.createDataFrame([(4, "COMMERCIAL", " acme "), (9, "COMMERCIAL", "no")], "event_id long, category string, brand string")

    plan = repair.plan_backfill(t, classify=model)
    assert {(r.event_id, r.brand_name, r.source) for r in plan.collect()} == {(1, "Ethos", "deterministic"), (2, "Ethos", "deterministic"), (3, "Ethos", "deterministic"), (4, "acme", "llm")} and asked == [4]
    after = repair.backfill_brands(t, plan, T0)
    got = {r.id: (r.commercial_id, r.brand_name) for r in after.events.where("id < 5").collect()}
    assert got[1][0] == got[2][0] and got[3] == (None, "Ethos") and len({got[i][0] for i in (1, 3, 4)}) == 3
    assert {r.id: (r.play_count, r.duration_bucket_seconds) for r in after.commercials.collect()} == {got[1][0]: (2, 20), got[4][0]: (1, 20)}
    assert sorted((r.segment_id, r.mention_type, r.heard_utc) for r in after.mentions.collect()) == [(i, "paid_ad", at(s)) for i, s in ((1, 0), (2, 900), (3, 1800), (4, 2400))]
    # what is heard again finds the ad that is there, whatever its number
    again = after.having(events=make(spark, events=[event(20, 9000, 20, "COMMERCIAL", transcript_excerpt="visit ethos.com for cover of your life today")]).events)
    more = repair.backfill_brands(again, repair.plan_backfill(again), T0)
    assert more.events.first().commercial_id == got[1][0] and {r.id: r.play_count for r in more.commercials.collect()}[got[1][0]] == 3


def test_mentions_bring_their_brands(spark):
    t = make(spark, events=[event(1, 0, 100)], brands=[{"id": 4, "canonical_name": "Known", "aliases": []}])
    said = spark.createDataFrame([("Known", "tag", at(5)), ("Newcomer", "tag", at(6)), ("Newcomer", "tag", at(7)), (None, "tag", at(8))], "name string, mention_type string, heard_utc timestamp")
    after = repair.attach_mentions(t, said, T0)
    assert {r.canonical_name for r in after.brands.collect()} == {"Known", "Newcomer"} and after.mentions.count() == 3


def test_maintenance_in_order(spark, tmp_path, monkeypatch):
    store, seen = Store(spark, str(tmp_path / "db")), []
    store.commit(shop(spark), None)
    pruned, told = [], []
    last = maintenance.maintain(store, str(tmp_path / "copy"), T0, prune=lambda t: pruned.append(t.events.count()), report=lambda t: told.append(t.songs.count()), keep=3, done=seen.append, releases=lambda t: t.songs.select(F.col("id").alias("song_id"), F.lit("1999-05").alias("first_release"), F.array().cast("array<string>").alias("release_dates")))
    assert seen == ["backup", "boundaries", "backfill", "commercials", "brands", "songs", "stitch", "enrich", "prune", "reports"]
    after = store.read()
    assert pruned == [5] and told == [1] and [(r.id, r.release_date) for r in after.songs.collect()] == [(2, "1999-05-01")] and len(store.versions()) == 3 and store.versions()[-1] == last.version
    assert Store(spark, str(tmp_path / "copy")).read().songs.count() == 2
    assert digest(maintenance.run_all(shop(spark), T0).songs)[0] == 1
    # a copy that isn't like its original stops everything before it begins
    other = Store(spark, str(tmp_path / "other"))
    other.commit(shop(spark), None)
    monkeypatch.setattr(Store, "copy_to", lambda self, path: __import__("tidemark.sources.store", fromlist=["check"]).check(self.read(), make(spark)))
    with pytest.raises(ValueError, match=r"differs in songs, events|differs in .*events"):
        maintenance.maintain(other, str(tmp_path / "bad"), T0, done=seen.append)
    assert other.versions() == [1] and seen[-1] == "reports"


def test_commands_on_a_store(spark, tmp_path, capsys):
    def say(*words, code=0):
        out = io.StringIO()
        assert cli.main(["--tables", str(tmp_path / "db"), *words], spark, out) == code
        return out.getvalue()

    say("db", "init")
    store = Store(spark, str(tmp_path / "db"))
    store.change(lambda t: shop(spark))
    assert say("db", "version").strip() == "4"
    window = ("--from", "2024-01-01T00:00:00Z", "--to", "2024-01-02T00:00:00Z")
    assert "A" in say("report", "songs", *window) and "| A" not in say("report", "songs", "--top", "0", *window)
    (tmp_path / "found.json").write_text('{"song_id": 2, "first_release": "1970", "release_dates": ["1969-02"]}\n')
    assert "not_found" in say("songs", "enrich-releases", "--found", str(tmp_path / "found.json"), "--dry-run", *window) and store.versions() == [1, 2]
    say("songs", "enrich-releases", "--found", str(tmp_path / "found.json"), *window)
    assert {r.id: r.release_date for r in store.read().songs.collect()} == {1: None, 2: "1969-02-01"}
    said = say("db", "maintain", "--backup", str(tmp_path / "copy"), "--report", str(tmp_path / "r.html"), *window)
    assert said.split() == ["backup", "boundaries", "backfill", "commercials", "brands", "songs", "stitch", "prune", "reports"] and "<h1>" in (tmp_path / "r.html").read_text()


def test_small_readers(spark, tmp_path):
    (tmp_path / "map.csv").write_text('mid,display_name\n/m/1,"Speech, male"\r\n\n/m/2,Music\n/m/3,Dog\n')
    assert [(r["index"], r.name, r.group) for r in readers.read_class_names(spark, str(tmp_path / "map.csv")).orderBy("index").collect()] == [(0, "Speech, male", "speech"), (1, "Music", "music"), (2, "Dog", "other")]
    (tmp_path / "numbered.csv").write_text("index,name\n7,Music\n3,Dog\n")
    assert {(r["index"], r.name) for r in readers.read_class_names(spark, str(tmp_path / "numbered.csv")).collect()} == {(7, "Music"), (3, "Dog")}
    old, new = datetime(2024, 1, 1), datetime(2024, 3, 1)
    files = spark.createDataFrame([("/c/a.wav", old), ("/c/b.wav", old), ("/c/c.wav", new), ("/c/d.wav", old)], "path string, modificationTime timestamp")
    cars = spark.createDataFrame([("/x/a.wav", True), ("/x/b.wav", False), ("/x/c.wav", True)], "wav_path string, complete boolean")
    assert [r.path for r in readers.prunable(files, cars, datetime(2024, 2, 1)).collect()] == ["/c/a.wav"]
    rows = spark.createDataFrame([('["a", "b"]',), ("[]",), ("x",), (None,)], "v string")
    assert [r.v for r in rows.select(text.json_list(F.col("v")).alias("v")).collect()] == [["a", "b"], [], [], []]


def test_counts_while_it_runs(spark, tmp_path):
    kinds = ["SONG", "DJ", None, "SONG", "COMMERCIAL", "DJ", "SONG", None]
    for i in range(2):
        part = spark.createDataFrame([(k,) for k in kinds[4 * i : 4 * i + 4]], "k string").select(F.when(F.col("k").isNotNull(), F.struct(F.struct(F.col("k").alias("category")).alias("key"))).alias("segment_input"))
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    whole = spark.read.parquet(str(tmp_path / "in" / "*"))
    df, seen = observed(whole)
    df.write.format("noop").mode("overwrite").save()
    want = {c: sum((k or "UNKNOWN") == c for k in kinds) for c in NAMES}
    assert seen.get == want
    said = []
    listener = Progress(tell=lambda number, counts, sums: said.append((number, sum(counts.values()), dict(sums))))
    spark.streams.addListener(listener)
    try:
        live, none = observed(spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")))
        q = live.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert none is None and [x[:2] for x in said if x[1]] == [(0, 4), (1, 4)] and said[-1][2] == want


def test_batches_of_a_matcher(spark):
    outputs = [(1, "Matched /tmp/q1.wav 5.0 sec as x/Spurious - Rip.webm at 1.0 s with 5 of 300 common hashes at rank 0\nMatched /tmp/q1.wav as Correct - Track.mp3 at 60.0 s with 50 of 200 common hashes at rank 1\r\nMatched q1.wav as Late - Equal.mp3 with 50 of 90\nNOMATCH /tmp/q2.wav\nnoise\nMatched q4.wav as AFI - Miss Murder.mp3 at  -3.2 s with 17 of 80 common hashes\n"), (2, None)]
    asked = [(1, "/tmp/q1.wav"), (1, "/tmp/q2.wav"), (1, "/tmp/q3.wav"), (1, "/tmp/q4.wav"), (2, "/tmp/q1.wav"), (3, "/tmp/q1.wav")]
    from tidemark.operators import resolve

    got = resolve.match_results(spark.createDataFrame(outputs, "batch int, stdout string"), spark.createDataFrame(asked, "batch int, query string")).collect()
    want = {(1, "q1"): ("match", "Correct", "Track", 50.0), (1, "q2"): ("no_match", None, None, None), (1, "q3"): ("no_match", None, None, None), (1, "q4"): ("match", "AFI", "Miss Murder", 17.0), (2, "q1"): ("error", None, None, None), (3, "q1"): ("error", None, None, None)}
    assert {(r.batch, r.query[5:7]): (r.status, r.artist, r.title, r.match_score) for r in got} == want


def test_a_song_heard_very_often(spark):
    import random

    rng = random.Random(8)
    kinds = [("BAND", "DONT", None, "shazam"), ("Band", "Don't", None, "shazam"), ("band", "Don_t", "t1", "audfprint"), ("Band", "Dont", "t2", "shazam"), ("Band", "Don’t", None, "manual")]
    for seed in (3,):
        rng.seed(seed)
        reports = [(i, *rng.choice(kinds)) for i in range(400)]
        fields = "seq long, artist string, title string, audfprint_track_id string, source string"
        once = repair.upsert_songs(make(spark), spark.createDataFrame(reports, fields).repartition(5), T0).songs.collect()
        # one after another, the first of each kind
        t, seen = make(spark), set()
        for r in reports[:40]:
            if r[1:] not in seen:
                seen.add(r[1:])
                t = t.having(songs=spark.createDataFrame(repair.upsert_songs(t, spark.createDataFrame([r], fields), T0).songs.collect(), t.songs.schema))
        assert len(seen) == len(kinds) and [tuple(r)[1:5] for r in once] == [tuple(r)[1:5] for r in t.songs.collect()]
