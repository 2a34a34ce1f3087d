"""The broadcast star schema: tables, enumerations, and the container that repairs map over."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

#: The classes of a segment, of a mention, and the sources of a song.
CATEGORIES = ("SONG", "DJ", "COMMERCIAL", "STATION", "PSA_NEWS")
MENTIONS = ("paid_ad", "dj_shoutout", "tag")
SONG_SOURCES = ("audfprint", "shazam", "manual")
VERSION = 4

DDL = {
    "brands": "id bigint, canonical_name string, aliases array<string>, created_at timestamp",
    "songs": "id bigint, audfprint_track_id string, artist string, title string, source string, first_seen_utc timestamp, release_date string",
    "commercials": "id bigint, brand_id bigint, duration_bucket_seconds int, minhash_hex string, reference_transcript string, first_heard_utc timestamp, play_count bigint",
    "capture_runs": "id bigint, run_id string, started_utc timestamp, ended_utc timestamp, pipeline_version string, host string, notes string, created_at timestamp",
    "events": "id bigint, timestamp_start timestamp, timestamp_end timestamp, duration double, category string, song_id bigint, commercial_id bigint, brand_id bigint, artist string, track_title string, brand_name string, transcript_excerpt string, confidence double, capture_run_id bigint, created_at timestamp",
    "mentions": "id bigint, segment_id bigint, brand_id bigint, mention_type string, heard_utc timestamp",
}


@dataclass(frozen=True)
class Tables:
    """The six tables. Repairs take one and return another; nothing is changed in place."""

    brands: DataFrame
    songs: DataFrame
    commercials: DataFrame
    capture_runs: DataFrame
    events: DataFrame
    mentions: DataFrame

    def having(self, **changed: DataFrame) -> Tables:
        return replace(self, **changed)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Tables:
        """The newest version of the tables under ``path`` (``sources.store``), or the plain tables there."""
        from tidemark.sources.store import Store

        return Store(spark, path).read()

    @classmethod
    def read_plain(cls, spark: SparkSession, path: str) -> Tables:
        """Parquet tables under ``path``, one folder each; events may be partitioned by date."""
        return cls(**{f.name: spark.read.schema(DDL[f.name]).parquet(f"{path}/{f.name}") for f in fields(cls)})

    @classmethod
    def empty(cls, spark: SparkSession) -> Tables:
        return cls(**{f.name: spark.createDataFrame([], DDL[f.name]) for f in fields(cls)})

    def write(self, path: str) -> None:
        """Write all tables to a new folder, one folder each."""
        for f in fields(self):
            getattr(self, f.name).write.parquet(f"{path}/{f.name}")

    def replace_at(self, path: str) -> None:
        """Commit these tables as the next version under ``path``, from which they may be read.

        A failure at any point leaves the version before as the newest.
        """
        from tidemark.sources.store import Store

        store = Store(self.events.sparkSession, path)
        store.commit(self, store.snapshot())

    def register(self) -> None:
        """Temporary views under the tables' names, and the key functions for SQL."""
        for f in fields(self):
            getattr(self, f.name).createOrReplaceTempView(f.name)


def register_key_functions(spark: SparkSession) -> None:
    """display_key, song_title_key and song_artist_key for SQL text, as vectorised functions of the same rules."""
    import re

    import pandas as pd
    from pyspark.sql import functions as F

    from tidemark.functions import text

    quotes = str.maketrans(dict.fromkeys(text.APOSTROPHES, "'"))

    def key(v: str | None) -> str:
        return " ".join((v or "").translate(quotes).replace("'", "").replace("_", "").split()).casefold()

    def py(pattern: str) -> re.Pattern:
        return re.compile(re.sub(r"^\(\?(i?)U\)", lambda m: "(?i)" if m[1] else "", pattern))

    def bare(v: str | None) -> str:
        return re.sub(text.TITLE_PUNCTUATION, " ", re.sub(r"\s+_", " ", v or "").replace("_", ""))

    feature, remix, tail, collab = (py(p) for p in (text.FEATURE_TAIL, text.REMIX_TAIL, text.UNDERSCORE_TAIL, text.REMIX_ARTIST_TAIL))

    def title_key(v: str | None) -> str:
        return " ".join(remix.sub("", feature.sub("", bare((v or "").translate(quotes)))).replace("'", "").split()).casefold()

    def artist_key(a: str | None, t: str | None) -> str:
        first = tail.sub("", a or "")
        return key(collab.sub("", first) if remix.search(bare(t)) else first)

    def each(s: pd.Series) -> pd.Series:
        return s.map(key)

    def titles(s: pd.Series) -> pd.Series:
        return s.map(title_key)

    def artists(a: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([artist_key(x, y) for x, y in zip(a, t, strict=True)])

    for name, rule in (("display_key", each), ("song_title_key", titles), ("song_artist_key", artists)):
        spark.udf.register(name, F.pandas_udf(rule, "string"))
