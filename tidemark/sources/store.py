"""Versions of the tables in one folder: data that never changes, and a manifest for each version."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, fields

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import DDL, VERSION, Tables


class Conflict(RuntimeError):
    """Another writer has committed since the version that a change started from."""


@dataclass(frozen=True)
class Snapshot:
    """A version: its number, the schema it is in, and the folder of each table."""

    version: int
    schema: int
    folders: dict[str, str]


class Store:
    """The tables under ``path``: ``data`` has folders of tables, ``_versions`` a manifest of each version.

    A commit writes the tables that changed to folders of their own and then puts its manifest in place by one
    rename that fails where a file is already: readers see the old version or the new one, whenever a writer ends, and of
    two writers that start from one version the second is refused. A folder of plain tables without manifests
    is read as it is; its first commit starts the versions.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._at(self.path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        """The numbers of all versions, in order."""
        folder, files = self._at(f"{self.path}/_versions"), self._files()
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot | None:
        """A version, the newest unless given; None if there is none."""
        there = self.versions()
        if not there or version is not None and version not in there:
            return None
        number = there[-1] if version is None else version
        said = json.loads(self.spark.read.text(f"{self.path}/_versions/{number:010}.json", wholetext=True).first()[0])
        return Snapshot(number, said["schema"], said["folders"])

    def read(self, snapshot: Snapshot | None = None) -> Tables:
        """The tables of a version, the newest unless given. Tables and columns that an older schema lacks are empty."""
        snapshot = snapshot or self.snapshot()
        if snapshot is None:
            return Tables.read_plain(self.spark, self.path)
        kept = {n: self.spark.read.schema(DDL[n]).parquet(f"{self.path}/{folder}") for n, folder in snapshot.folders.items()}
        return Tables(**{f.name: kept[f.name] if f.name in kept else self.spark.createDataFrame([], DDL[f.name]) for f in fields(Tables)})

    def commit(self, tables: Tables, base: Snapshot | None, was: Tables | None = None, schema: int = VERSION) -> Snapshot:
        """``tables`` as the version after ``base`` (None: the first). Tables that are those of ``was``, as read from base, keep their folders."""
        folders = {}
        for f in fields(tables):
            df = getattr(tables, f.name)
            if base is not None and was is not None and df is getattr(was, f.name) and f.name in base.folders:
                folders[f.name] = base.folders[f.name]
            else:
                folders[f.name] = f"data/{f.name}-{uuid.uuid4().hex}"
                df.write.parquet(f"{self.path}/{folders[f.name]}")
        after = Snapshot((base.version if base else 0) + 1, schema, folders)
        self._publish(after)
        return after

    def _publish(self, s: Snapshot) -> None:
        files, jvm = self._files(), self.spark._jvm
        draft, final = (self._at(f"{self.path}/_versions/{name}") for name in (f".draft-{uuid.uuid4().hex}", f"{s.version:010}.json"))
        out = files.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"schema": s.schema, "folders": s.folders}).encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        plainly = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(files.makeQualified(draft), files.makeQualified(final), plainly)
        except Py4JJavaError as e:
            files.delete(draft, False)
            if files.exists(final):
                raise Conflict(f"version {s.version} is there already") from None
            raise OSError(str(e.java_exception)) from e

    def change(self, how: Callable[[Tables], Tables], tries: int = 3) -> Snapshot:
        """Reads the newest version, changes it and commits; anew from the newest if another writer was first."""
        for left in reversed(range(tries)):
            base = self.snapshot()
            was = self.read(base)
            try:
                return self.commit(how(was), base, was)
            except Conflict:
                if not left:
                    raise
        raise ValueError("at least one try")

    def copy_to(self, path: str, snapshot: Snapshot | None = None) -> Snapshot:
        """A copy of a version in another folder, held against the original: rows and digests of every table must agree."""
        mine = self.read(snapshot)
        other = Store(self.spark, path)
        made = other.commit(mine, other.snapshot(), schema=(snapshot or self.snapshot() or Snapshot(0, VERSION, {})).schema)
        check(mine, other.read(made))
        return made

    def prune(self, keep: int = 2) -> list[str]:
        """Drops all but the ``keep`` newest versions, and the folders that only those had; tells which."""
        if keep < 1:
            raise ValueError("the newest version stays")
        there, files = self.versions(), self._files()
        old, new = there[:-keep], there[-keep:]
        used = {f for v in new for f in self.snapshot(v).folders.values()}
        gone = sorted({f for v in old for f in self.snapshot(v).folders.values()} - used)
        for v in old:  # manifests first: what a manifest names is there
            files.delete(self._at(f"{self.path}/_versions/{v:010}.json"), False)
        for f in gone:
            files.delete(self._at(f"{self.path}/{f}"), True)
        return gone

    def migrate(self, now) -> Snapshot | None:
        """From schema 2 (no runs) or 3 (no release dates) to the newest, a version for each step; None if nothing is there."""
        from tidemark.operators.repair import add_runs

        steps = {2: lambda t: add_runs(t, now), 3: lambda t: t.having(songs=t.songs.select("*"))}
        base = self.snapshot()
        while base is not None and base.schema != VERSION:
            if base.schema not in steps:
                raise ValueError(f"schema {base.schema} isn't known")
            was = self.read(base)
            base = self.commit(steps[base.schema](was), base, was, schema=base.schema + 1)
        return base


def digest(df: DataFrame) -> tuple[int, int]:
    """Rows, and a sum of their hashes that their order doesn't change."""
    n, h = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return n, int(h or 0)


def check(original: Tables, copy: Tables) -> None:
    """Raises an error that names the tables in which the copy differs."""
    wrong = [f.name for f in fields(original) if digest(getattr(original, f.name)) != digest(getattr(copy, f.name))]
    if wrong:
        raise ValueError(f"the copy differs in {', '.join(wrong)}")
