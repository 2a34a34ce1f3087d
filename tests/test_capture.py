import json
import time
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.sources import capture, readers, wav, writers
from tidemark.streaming import watch

START = datetime(2024, 1, 1)


def write(folder, run, index, first, pcm, rate=10):
    folder.mkdir(exist_ok=True)
    name = writers.chunk_name(run, index)
    (folder / name).write_bytes(writers.wav_bytes(pcm, rate))
    side = writers.sidecar(run, index, START + timedelta(seconds=first / rate), rate, pcm, True)
    (folder / name.replace(".wav", ".json")).write_text(json.dumps(side))


def samples(begin, n):
    return np.arange(begin, begin + n, dtype="<i2").tobytes()


def windows_of(n, size=20, hop=10):
    """Brute force: (first sample, samples) of each full window of n consecutive samples."""
    return [(a, samples(a, size)) for a in range(0, n - size + 1, hop)]


def got(df):
    rows = [(r.run_id, (r.window_start - START).total_seconds() * r.sample_rate_hz, bytes(r.pcm)) for r in df.collect()]
    return sorted((run, round(at), pcm) for run, at, pcm in rows)


def opened(reader, **more):
    return reader.format("capture_windows").options(seconds="2", hop="1", windowsPerTask="3", **more)


def test_batch_over_borders(spark, tmp_path):
    spark.dataSource.register(capture.CaptureWindows)
    folder, at = tmp_path / "a", 0
    for index, n in enumerate([7, 45, 0, 3, 33], 1):  # shorter than a window, longer, empty
        write(folder, "r", index, at, samples(at, n))
        at += n
    write(folder, "short", 1, 0, samples(0, 19))
    (folder / "notes.txt").write_text("x")
    df = opened(spark.read).load(str(folder))
    assert got(df) == [("r", a, pcm) for a, pcm in windows_of(88)]
    first = df.orderBy("window_start").first()
    assert (first.block_index, first.frame_count, first.window_end) == (2, 20, START + timedelta(seconds=2))
    assert opened(spark.read).load(str(tmp_path / "none")).count() == 0


def test_holes_and_rates(spark, tmp_path):
    spark.dataSource.register(capture.CaptureWindows)
    folder = tmp_path / "a"
    write(folder, "r", 1, 0, samples(0, 25))
    write(folder, "r", 3, 100, samples(100, 25))
    write(folder, "r", 4, 60, samples(200, 25), rate=5)  # another rate: windows begin anew
    write(folder, "late", 2, 0, samples(0, 50))
    assert got(opened(spark.read).load(str(folder))) == [("r", 0, samples(0, 20))]
    passed = got(opened(spark.read, holes="pass").load(str(folder)))
    assert passed == [("late", 0, samples(0, 20)), ("late", 10, samples(10, 20)), ("late", 20, samples(20, 20)), ("late", 30, samples(30, 20)), ("r", 0, samples(0, 20)),
                      ("r", 60, samples(200, 10)), ("r", 65, samples(205, 10)), ("r", 70, samples(210, 10)), ("r", 75, samples(215, 10)), ("r", 100, samples(100, 20))]
    with pytest.raises(Exception, match="hop has to be positive"):
        opened(spark.read).option("hop", "3").load(str(folder)).count()
    (folder / "r_block0001.wav").write_bytes(writers.wav_bytes(samples(0, 5), 10))
    with pytest.raises(Exception, match="fewer samples"):
        opened(spark.read).load(str(folder)).count()


def test_stream_once_each_after_restarts(spark, tmp_path):
    """What the WAV sink writes comes back as the same windows, once each, with a stop after every chunk; pruned recordings aren't read again."""
    spark.dataSource.register(capture.CaptureWindows)
    spark.dataSource.register(wav.WavChunks)
    folder, out, at = tmp_path / "chunks", tmp_path / "out", 0

    def drain():
        q = opened(spark.readStream).load(str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
        q.trigger(availableNow=True).start(str(out)).awaitTermination(60)

    sizes = [25, 8, 31, 20]
    for index, n in enumerate(sizes, 1):
        chunk = [("r", index, START + timedelta(seconds=at / 10), 10, True, samples(at, n))]
        spark.createDataFrame(chunk, wav.CHUNK).write.format("wav_chunks").mode("append").save(str(folder))
        at += n
        drain()
        assert got(spark.read.parquet(str(out))) == [("r", a, pcm) for a, pcm in windows_of(at)]
        if index == 3:  # its samples are out, the next windows need chunks 2 and 3 only
            (folder / "r_block0001.wav").unlink()
    drain()  # nothing new
    assert spark.read.parquet(str(out)).count() == len(windows_of(at))


class Fake:
    def __init__(self, step):
        self.step, self.stopped = step, False

    def awaitTermination(self, seconds):  # noqa: N802
        return self.step()

    def stop(self):
        self.stopped = True


def test_run_until(spark):
    have, made = [0.0], []

    def starts(*steps):
        todo = list(steps)

        def start():
            made.append(Fake(todo.pop(0)))
            return made[-1]

        return start

    def more():
        have[0] += 10
        return False

    assert watch.run_until(starts(lambda: bool(time.sleep(0.3)), more), lambda: have[0], 50, still=0.2, poll=1) == 50  # stood still once, then ran
    assert len(made) == 2 and all(q.stopped for q in made)
    assert watch.run_until(starts(), lambda: 50.0, 50, still=1) == 50  # nothing to do
    with pytest.raises(RuntimeError, match="2 starts in a row brought nothing; 50 of 60"):
        watch.run_until(starts(lambda: True, lambda: True), lambda: have[0], 60, still=1, poll=1, tries=2)
    assert watch.run_until(starts(more), lambda: have[0], 69, still=1, poll=1, tolerance=10) == 60
    side = spark.createDataFrame([("r", 1, 100, 10), ("r", 2, None, 10), ("r", 3, 5, 0)], "run_id string, block_index int, samples long, sample_rate_hz int")
    assert watch.audio_seconds(side) == 10.0 and watch.audio_seconds(side.where("false")) == 0.0
