"""Sinks: WAV files, rolling chunks, JSON lines, tracklists."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wav_bytes(pcm: bytes, rate: int) -> bytes:
    """A mono 16-bit WAV file of the samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(pcm))
    return head + pcm


def chunk_name(run_id: str, index: int) -> str:
    return f"{run_id}_block{index:04d}.wav"


def sidecar(run_id: str, index: int, begin: datetime, rate: int, pcm: bytes, complete: bool) -> dict:
    """What is told of a chunk beside its WAV file."""
    n = len(pcm) // 2
    return {
        "run_id": run_id,
        "block_index": index,
        "wav_path": chunk_name(run_id, index),
        "capture_start_utc": begin.isoformat(),
        "capture_end_utc": (begin + timedelta(seconds=n / rate)).isoformat(),
        "sample_rate_hz": rate,
        "channels": 1,
        "sample_width_bytes": 2,
        "samples": n,
        "duration_seconds": n / rate,
        "complete": complete,
    }


def rolling_chunks(stream: Iterable[bytes], run_id: str, start: datetime, rate: int, seconds: float = 1800) -> Iterator[tuple[dict, bytes]]:
    """(sidecar, WAV file) of each fixed-size chunk of a byte stream, numbered from 1.

    An odd byte waits for its other half. The last chunk may be short: it is marked incomplete. A stream
    without samples gives none, and one that ends with a chunk no empty one after it.
    """
    samples, held, index = max(1, round(seconds * rate)), b"", 1

    def made(pcm: bytes, complete: bool) -> tuple[dict, bytes]:
        begin = start + timedelta(seconds=(index - 1) * samples / rate)
        return sidecar(run_id, index, begin, rate, pcm, complete), wav_bytes(pcm, rate)

    for piece in stream:
        held += piece
        while len(held) >= 2 * samples:
            yield made(held[: 2 * samples], True)
            held, index = held[2 * samples :], index + 1
    if len(held) > 1:
        yield made(held[: len(held) // 2 * 2], False)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a row, nulls included."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def append_tracklist(path: str, entries: list[tuple[str, str]], day: date, note: str = "promoted") -> int:
    """Appends a dated batch to a tracklist file that must exist; a driver-side step for a handful of rows."""
    if not entries:
        return 0
    with open(path, "r+", encoding="utf-8") as f:
        text = f.read()
        f.write(("" if text.endswith("\n") or not text else "\n") + f"\n# {day.isoformat()} {note}\n" + "".join(f"{a} | {t}\n" for a, t in entries))
    return len(entries)
