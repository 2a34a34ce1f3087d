"""WAV chunks as a Spark sink, batch and streaming: each row becomes a WAV file and its sidecar.

``spark.dataSource.register(WavChunks)``, then ``df.write.format("wav_chunks").mode("append").save(path)`` or
``df.writeStream.format("wav_chunks")``. Executors write the files; the driver sees a number for each task.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.sources.writers import chunk_name, sidecar, wav_bytes

#: The columns of a chunk; pcm is mono 16-bit.
CHUNK = "run_id string, block_index int, capture_start_utc timestamp, sample_rate_hz int, complete boolean, pcm binary"


@dataclass
class Written(WriterCommitMessage):
    files: int


def _write(path: str, rows: Iterator[Row]) -> Written:
    """A file gets its name when it is whole, and the sidecar comes last, so a task that runs again does no harm."""
    from pyarrow.fs import FileSystem

    files, root = FileSystem.from_uri(path)
    files.create_dir(root, recursive=True)

    def put(name: str, content: bytes) -> None:
        hidden = f"{root}/.{uuid.uuid4().hex}"
        with files.open_output_stream(hidden) as out:
            out.write(content)
        files.move(hidden, f"{root}/{name}")

    n = 0
    for r in rows:
        pcm, name = bytes(r.pcm or b""), chunk_name(r.run_id, r.block_index)
        side = sidecar(r.run_id, r.block_index, r.capture_start_utc, r.sample_rate_hz, pcm, bool(r.complete))
        put(name, wav_bytes(pcm, r.sample_rate_hz))
        put(name.removesuffix(".wav") + ".json", json.dumps(side).encode())
        n += 1
    return Written(n)


class _Batch(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Written:
        return _write(self.path, iterator)


class _Stream(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Written:
        return _write(self.path, iterator)


class WavChunks(DataSource):
    """Rows of CHUNK -> files under ``path``. A chunk that comes again is written over; a null pcm is an empty file."""

    @classmethod
    def name(cls) -> str:
        return "wav_chunks"

    def schema(self) -> str:
        return CHUNK

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("wav_chunks only appends")
        return _Batch(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _Stream(self.options["path"])
