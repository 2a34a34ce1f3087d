import io
from datetime import datetime

import numpy as np
import pytest

from tidemark.plans import render
from tidemark.sources import readers, wav, writers


def test_wav_round_trip(spark, tmp_path):
    pcm = np.arange(-500, 500, dtype="<i2").tobytes()
    (tmp_path / "a.wav").write_bytes(writers.wav_bytes(pcm, 8000))
    r = readers.read_wav(spark, str(tmp_path)).first()
    assert (bytes(r.pcm), r.sample_rate_hz, r.samples) == (pcm, 8000, 1000)
    with pytest.raises(ValueError):
        readers.pcm_of_wav(writers.wav_bytes(pcm, 8000).replace(b"\x01\x00\x01\x00", b"\x01\x00\x02\x00", 1))


def test_chunks():
    chunks = list(writers.rolling_chunks([b"\x01" * 7, b"\x02" * 6], "r", datetime(2024, 1, 1), rate=2, seconds=1))
    assert [(c["samples"], c["complete"]) for c, _ in chunks] == [(2, True), (2, True), (2, True)]
    assert [c["block_index"] for c, _ in chunks] == [1, 2, 3] and chunks[2][0]["capture_start_utc"] == "2024-01-01T00:00:02"
    assert list(writers.rolling_chunks([], "r", datetime(2024, 1, 1), 2)) == []
    tail = [(c["samples"], c["complete"]) for c, _ in writers.rolling_chunks([b"\x01" * 7], "r", datetime(2024, 1, 1), rate=2, seconds=1)]
    assert tail == [(2, True), (1, False)]


def test_chunk_sink(spark, tmp_path):
    spark.dataSource.register(wav.WavChunks)
    pcm, start = np.arange(10, dtype="<i2").tobytes(), datetime(2024, 1, 1)
    df = spark.createDataFrame([("r", 1, start, 5, True, pcm), ("r", 2, start, 5, False, None)], wav.CHUNK)
    for _ in range(2):  # again: written over
        df.write.format("wav_chunks").mode("append").save(str(tmp_path / "a"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(wav.CHUNK).parquet(str(tmp_path / "in")).writeStream.format("wav_chunks")
    stream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "b")).awaitTermination()
    for folder in (tmp_path / "a", tmp_path / "b"):
        assert {r.path.rpartition("/")[2]: bytes(r.pcm) for r in readers.read_wav(spark, str(folder)).collect()} == {"r_block0001.wav": pcm, "r_block0002.wav": b""}
        sides = {r.block_index: (r.samples, r.duration_seconds, r.complete) for r in readers.read_sidecars(spark, str(folder)).collect()}
        assert sides == {1: (10, 2.0, True), 2: (0, 0.0, False)}


def test_text_sources(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# c\n\nA | B | C\nnone\n D|E \n")
    assert sorted(tuple(r) for r in readers.read_tracklist(spark, str(tmp_path / "t.txt")).collect()) == [("A", "B | C"), ("D", "E")]
    (tmp_path / "t.csv").write_text("#x\na.wav, noise\nb.wav,Art,Tit\n")
    assert sorted(tuple(r) for r in readers.read_truth(spark, str(tmp_path / "t.csv"), "/base").collect()) == [("/base/a.wav", "noise"), ("/base/b.wav", "Art - Tit")]


def test_answers(spark):
    rows = ['{"class":"COMMERCIAL","brand":" ","commercial_signature":{"key_phrases":["a"," "],"duration_bucket_seconds":20},"confidence":"0.5","extra":1}', '{"class":"DJ","commercial_signature":{"key_phrases":[],"duration_bucket_seconds":20}}', '{"class":"BAD"}', '{"class":"DJ","confidence":"7"}', "nonsense"]
    got = readers.parse_answers(spark.createDataFrame([(r,) for r in rows], "j string"), "j").collect()
    assert [r.valid for r in got] == [True, True, False, False, False]
    assert got[0].answer.brand is None and got[0].answer.commercial_signature.key_phrases == ["a"] and got[1].answer.commercial_signature is None


def test_scrape_and_render(spark):
    page = '<ul><li class="song"><span class="artist">A</span><b class="title">T &amp; U</b></li><li class="song"><span class="artist">a</span><b class="title">t &amp; u</b></li></ul>'
    df = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    assert [(r.artist, r.title) for r in readers.scrape_tracks(df, "id", "html", "li.song", ".artist", ".title").collect()] == [("A", "T & U")]
    assert "sp…" in render.table(df) and "T &amp; U" in render.table(df, widths={"html": 500}) and io.StringIO(render.section("x<", df)).read().startswith("<section><h2>x&lt;")
