"""Windows of captured audio, read from WAV chunks and their sidecars, as a batch or as the chunks appear.

``spark.dataSource.register(CaptureWindows)``, then ``spark.readStream.format("capture_windows").load(folder)`` or
``spark.read``. The driver lists names and reads sidecars, of some 300 bytes; samples are only read by tasks.
"""

from __future__ import annotations

import json
import wave
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: The columns of a window; pcm is mono 16-bit, block_index the chunk that it ends in.
WINDOW = "run_id string, block_index int, window_start timestamp, window_end timestamp, sample_rate_hz int, frame_count bigint, pcm binary"


@dataclass(frozen=True)
class Block:
    """A chunk, and where it lies in its stretch: a part of a run without a hole or a change of rate."""

    index: int
    wav: str
    rate: int
    samples: int
    begin: datetime
    stretch: int
    first: int

    @property
    def end(self) -> int:
        return self.first + self.samples


@dataclass
class Windows(InputPartition):
    """Windows ``least`` to ``most`` of a stretch that begins at ``begin``, and the chunks that they touch."""

    run: str
    begin: datetime
    size: int
    hop: int
    least: int
    most: int
    blocks: list[Block]


def in_order(sidecars: list[dict], pass_holes: bool) -> list[Block]:
    """The chunks of a run up to the first one that hasn't come yet; with ``pass_holes`` all, where a hole ends a stretch."""
    out: list[Block] = []
    for s in sorted(sidecars, key=lambda s: s["block_index"]):
        index, rate, begin = s["block_index"], s["sample_rate_hz"], datetime.fromisoformat(s["capture_start_utc"])
        begin = begin if begin.tzinfo else begin.replace(tzinfo=UTC)
        last = out[-1] if out else None
        hole = index != (last.index + 1 if last else 1)
        if hole and not pass_holes:
            break
        goes_on = last is not None and not hole and last.rate == rate
        out.append(Block(index, s["wav_path"].rpartition("/")[2], rate, s["samples"], begin, last.stretch if goes_on else index, last.end if goes_on else 0))
    return out


class _Folder:
    """The chunks of a folder and what windows they make; sidecars are read once each."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.seconds, self.hop = float(options.get("seconds", 20)), float(options.get("hop", 10))
        self.per_task = int(options.get("windowsPerTask", 64))
        holes = options.get("holes", "wait")
        if not 0 < self.hop <= self.seconds or self.per_task < 1 or holes not in ("wait", "pass"):
            raise ValueError("hop has to be positive and no longer than seconds, windowsPerTask 1 or more, holes wait or pass")
        self.pass_holes = holes == "pass"
        self.read: dict[str, dict] = {}

    def runs(self) -> dict[str, list[Block]]:
        from pyarrow.fs import FileSelector, FileSystem

        files, root = FileSystem.from_uri(self.path)
        for f in files.get_file_info(FileSelector(root, allow_not_found=True)):
            if f.base_name.endswith(".json") and not f.base_name.startswith(".") and f.base_name not in self.read:
                with files.open_input_stream(f.path) as stream:
                    self.read[f.base_name] = json.loads(stream.read())
        by_run: dict[str, list[dict]] = {}
        for s in self.read.values():
            by_run.setdefault(s["run_id"], []).append(s)
        return {run: blocks for run, found in sorted(by_run.items()) if (blocks := in_order(found, self.pass_holes))}

    def latest(self) -> dict[str, int]:
        return {run: blocks[-1].index for run, blocks in self.runs().items()}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Windows]:
        """Windows that end in a chunk after ``start`` and up to ``end``."""
        out = []
        for run, blocks in self.runs().items():
            after, until = start.get(run, 0), end.get(run, 0)
            for stretch in sorted({b.stretch for b in blocks if after < b.index <= until}):
                mine = [b for b in blocks if b.stretch == stretch and b.index <= until]
                size, hop = round(self.seconds * mine[0].rate), max(1, round(self.hop * mine[0].rate))
                done = max((b.end for b in mine if b.index <= after), default=0)
                # a window that ends at or before done is out already: the first new one ends behind it
                least = 0 if done < size else (done - size) // hop + 1
                most = (mine[-1].end - size) // hop
                for at in range(least, most + 1, self.per_task):
                    to = min(at + self.per_task - 1, most)
                    touched = [b for b in mine if b.samples and b.end > at * hop and b.first < to * hop + size]
                    out.append(Windows(run, mine[0].begin, size, hop, at, to, touched))
        return out

    def rows(self, part: Windows) -> Iterator[tuple]:
        from pyarrow.fs import FileSystem

        files, root = FileSystem.from_uri(self.path)
        open_, at = {}, 0
        try:
            for n in range(part.least, part.most + 1):
                first, end, pieces = n * part.hop, n * part.hop + part.size, []
                while part.blocks[at].end <= first:  # no later window needs it
                    for handle in reversed(open_.pop(at, ())):
                        handle.close()
                    at += 1
                for i in range(at, len(part.blocks)):
                    b = part.blocks[i]
                    if b.first >= end:
                        break
                    if i not in open_:
                        raw = files.open_input_file(f"{root}/{b.wav}")
                        open_[i] = (raw, wave.open(raw))
                    wav = open_[i][1]
                    if (wav.getnchannels(), wav.getsampwidth(), wav.getframerate()) != (1, 2, b.rate):
                        raise ValueError(f"{b.wav} isn't mono with 16 bits at {b.rate} Hz")
                    skip = max(first - b.first, 0)
                    wav.setpos(skip)
                    pieces.append(wav.readframes(min(end, b.end) - b.first - skip))
                pcm, rate = b"".join(pieces), part.blocks[0].rate
                if len(pcm) != 2 * part.size:
                    raise ValueError(f"a chunk of run {part.run} holds fewer samples than its sidecar says")
                last = next(b for b in part.blocks if b.end >= end)
                begin = part.begin + timedelta(seconds=first / rate)
                yield part.run, last.index, begin, begin + timedelta(seconds=part.size / rate), rate, part.size, pcm
        finally:
            for handles in open_.values():
                for handle in reversed(handles):
                    handle.close()


class _Batch(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self) -> list[Windows]:
        return self.folder.partitions({}, self.folder.latest())

    def read(self, partition: Windows | None) -> Iterator[tuple]:
        return self.folder.rows(partition) if partition else iter(())


class _Stream(DataSourceStreamReader):
    """Offsets are the last chunk of each run whose windows are out."""

    def __init__(self, folder: _Folder):
        self.folder = folder

    def initialOffset(self) -> dict[str, int]:
        return {}

    def latestOffset(self) -> dict[str, int]:
        return self.folder.latest()

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Windows]:
        return self.folder.partitions(start, end)

    def read(self, partition: Windows | None) -> Iterator[tuple]:
        return self.folder.rows(partition) if partition else iter(())


class CaptureWindows(DataSource):
    """A folder of chunks -> WINDOW, one row for each full window of a run.

    Options: ``seconds`` (20) and ``hop`` (10) of a window, ``windowsPerTask`` (64), ``holes``. Windows are aligned
    to the start of their run and run over the borders of chunks; the partial one at the end goes. A chunk
    counts from when its sidecar is there, which the sink writes last. A run waits at a chunk that hasn't come
    (numbers begin with 1); with ``holes`` = ``pass``, for captures whose chunks come in order, windows begin
    anew behind the hole. They also do where the rate changes. Empty chunks and an empty or absent folder give no window.

    Recordings may be pruned once their windows are out, sidecars have to stay: they tell where a chunk lies.
    After a restart each window comes once, as far as the sink keeps Spark's promises.
    """

    @classmethod
    def name(cls) -> str:
        return "capture_windows"

    def schema(self) -> str:
        return WINDOW

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(_Folder(dict(self.options)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(_Folder(dict(self.options)))
