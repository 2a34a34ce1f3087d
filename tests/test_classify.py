import json
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import classify, reports
from tidemark.schemas import Tables
from tidemark.sources import capture, wav
from tidemark.sources.store import Store

START = datetime(2024, 1, 1)
FP = "struct<status: string, track_id: string, artist: string, title: string, match_score: double>"
AC = "struct<label: string, music_prob: double, speech_prob: double>"
SZ = "struct<status: string, artist: string, title: string, confidence: double>"
#: What is on air in each of ten seconds of chunks 1 and 2: the level of the samples tells the models what they hear.
AIR = [3000] * 6 + [4000] * 4 + [5000] * 6 + [10] * 4


def models(spark):
    """Models that know what is on air by the level, and counters of the windows that they were asked about."""
    count = {n: spark.sparkContext.accumulator(0) for n in ("listen", "ask", "transcribe", "judge")}

    def model(name, answer, schema):
        n = count[name]

        def run(frames):
            for f in frames:
                n.add(len(f))
                yield answer(f)

        return lambda df: df.mapInPandas(run, schema)

    def level(f):
        return [int(np.median(np.frombuffer(b, "<i2"))) for b in f["pcm"]]

    def listen(f):
        fp = [{"status": "match" if v == 3000 else "no_match", "track_id": "t" if v == 3000 else None, "artist": "A" if v == 3000 else None, "title": "T" if v == 3000 else None, "match_score": 90.0 if v == 3000 else 0.0} for v in level(f)]
        ac = [{"label": "MUSIC" if v in (3000, 4000) else "SPEECH", "music_prob": 0.9 if v in (3000, 4000) else 0.1, "speech_prob": 0.05 if v in (3000, 4000) else 0.8} for v in level(f)]
        return f[["key"]].assign(fp=fp, ac=ac)

    def ask(f):
        return f[["key"]].assign(sz=[{"status": "match", "artist": "B", "title": "U", "confidence": 0.8}] * len(f))

    def judge(f):
        return f[["key"]].assign(answer_json=json.dumps({"class": "COMMERCIAL", "brand": "Acme Tools", "confidence": 0.9}))

    made = (
        model("listen", listen, f"key string, fp {FP}, ac {AC}"),
        model("ask", ask, f"key string, sz {SZ}"),
        model("transcribe", lambda f: f[["key"]].assign(transcript="buy acme tools while they last"), "key string, transcript string"),
        model("judge", judge, "key string, answer_json string"),
    )
    return made, count


@pytest.fixture
def chunks(spark, tmp_path):
    """Two chunks of 100 seconds, as the WAV sink writes them."""
    spark.dataSource.register(wav.WavChunks)
    spark.dataSource.register(capture.CaptureWindows)
    pcm = np.repeat(np.array(AIR, "<i2"), 100)  # 10 Hz
    rows = [("r", i + 1, START + timedelta(seconds=100 * i), 10, True, pcm[1000 * i : 1000 * (i + 1)].tobytes()) for i in range(2)]
    spark.createDataFrame(rows, wav.CHUNK).write.format("wav_chunks").mode("append").save(str(tmp_path / "wav"))
    return spark.read.format("capture_windows").load(str(tmp_path / "wav"))


def test_from_wav_to_report(spark, chunks, tmp_path):
    asked, count = models(spark)
    made = classify.classify(Tables.empty(spark), chunks, 7, *asked)
    Store(spark, str(tmp_path / "db")).commit(made, None)
    t = Tables.read(spark, str(tmp_path / "db"))
    events = t.events.orderBy("timestamp_start").collect()
    assert {e.capture_run_id for e in events} == {7} and len({e.id for e in events}) == len(events)
    seconds = Counter()
    for e in events:
        seconds[e.category, e.artist, e.brand_name] += e.duration
        assert START <= e.timestamp_start < e.timestamp_end <= START + timedelta(seconds=200)
    assert {k[:2] for k in seconds} == {("SONG", "A"), ("SONG", "B"), ("COMMERCIAL", None)}
    window = {"since": START, "until": START + timedelta(days=1)}
    assert {r.category for r in reports.summary(t, **window).collect() if r[1]} >= {"SONG", "COMMERCIAL"}
    windows = chunks.count()
    assert windows == 19 and count["listen"].value == windows
    assert 0 < count["ask"].value <= 5 and count["transcribe"].value == count["judge"].value < windows


def test_no_windows(spark, chunks):
    asked, count = models(spark)
    assert classify.classify(Tables.empty(spark), chunks.limit(0), None, *asked).events.count() == 0
    assert not any(c.value for c in count.values())
