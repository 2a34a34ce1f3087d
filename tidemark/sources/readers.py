"""Sources: recordings, sidecars, tracklists, truth tables, scraped pages, model output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.selectors import Rows

SIDECAR = "run_id string, block_index int, wav_path string, capture_start_utc timestamp, capture_end_utc timestamp, sample_rate_hz int, channels int, sample_width_bytes int, samples bigint, duration_seconds double, complete boolean"


def pcm_of_wav(content: bytes) -> tuple[bytes, int]:
    """(16-bit little-endian mono samples, rate) of a WAV file; other layouts are an error."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate, data = 12, None, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = np.frombuffer(body[:16], "<u2, <u2, <u4, <u4, <u2, <u2")[0]
            if channels != 1:
                raise ValueError("expected mono")
            if bits != 16 or kind not in (1, 0xFFFE):
                raise ValueError("expected 16-bit samples")
        elif name == b"data":
            data = body
        at += 8 + size + (size & 1)
    if rate is None or data is None:
        raise ValueError("incomplete WAV file")
    return data, int(rate)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """path, sample_rate_hz, samples, pcm of each mono 16-bit WAV file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *pcm_of_wav(c)) for p, c in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame([(p, rate, len(pcm) // 2, pcm) for p, pcm, rate in rows], columns=["path", "sample_rate_hz", "samples", "pcm"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, sample_rate_hz int, samples long, pcm binary")


def rms(pcm: Column) -> Column:
    """Root mean square of 16-bit samples."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: float(np.sqrt(np.mean(np.frombuffer(b, "<i2").astype(np.float32) ** 2))) if b else 0.0)

    return F.pandas_udf(run, "double")(pcm)


def resample_16k(pcm: Column, rate: Column) -> Column:
    """Samples at 16 kHz as floats in -1..1: a windowed-sinc filter on a rational grid."""

    def one(b: bytes, hz: int) -> list[float]:
        x = np.frombuffer(b, "<i2").astype(np.float64) / 32768
        if hz == 16_000 or not len(x):
            return x.tolist()
        g = np.gcd(16_000, hz)
        up, down = 16_000 // g, hz // g
        half = 10 * max(up, down)
        t = np.arange(-half, half + 1)
        h = np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, 5.0) / max(up, down) * up
        n = -(-len(x) * up // down)
        centre = np.arange(n) * down  # on the upsampled grid
        reach = half // up + 1
        k = centre // up
        out = np.zeros(n)
        for j in range(-reach, reach + 1):
            i = k + j
            tap = centre - i * up
            ok = (i >= 0) & (i < len(x)) & (np.abs(tap) <= half)
            out[ok] += x[i[ok]] * h[tap[ok] + half]
        return out.tolist()

    def run(s: pd.Series, hz: pd.Series) -> pd.Series:
        return pd.Series([one(b or b"", int(r)) for b, r in zip(s, hz, strict=True)])

    return F.pandas_udf(run, "array<float>")(pcm, rate)


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """The sidecars of a folder, which may hold the recordings as well."""
    return spark.read.schema(SIDECAR).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)


def stream_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Sidecars as they appear, one JSON object a file; the folder may hold the recordings as well."""
    return spark.readStream.schema(SIDECAR).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)


def prunable(files: DataFrame, sidecars: DataFrame, before) -> DataFrame:
    """Recordings (path, modificationTime) old enough whose sidecar says they are complete."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    done = sidecars.where("complete").select(F.regexp_extract("wav_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("_stem"))
    return files.where(F.col("modificationTime") < F.lit(before)).withColumn("_stem", stem).join(done, "_stem", "left_semi").drop("_stem")


def read_tracklist(spark: SparkSession, path: str) -> DataFrame:
    """artist, title of lines ``artist | title``; others, blank ones and comments are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#') and contains(v, '|')")
    part = F.split("v", r"\|", 2)
    return lines.select(F.trim(part[0]).alias("artist"), F.trim(part[1]).alias("title"))


def read_truth(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """clip, label of a CSV: two columns, or three that make ``artist - title``. Relative clips lie under ``base``."""
    rows = spark.read.schema("clip string, a string, b string").option("comment", "#").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    label = F.when(F.col("b").isNull(), F.col("a")).otherwise(F.concat_ws(" - ", "a", "b"))
    clip = F.when(F.col("clip").startswith("/"), F.col("clip")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), "clip")) if base else F.col("clip")
    return rows.where("clip is not null and a is not null").select(clip.alias("clip"), label.alias("label"))


def read_class_names(spark: SparkSession, path: str) -> DataFrame:
    """index, name, group of a class map CSV: its display_name column, else the last."""
    from tidemark.operators.funnel import class_group

    names = spark.read.option("header", "true").csv(path).columns
    column = "display_name" if "display_name" in names else names[-1]
    # one row a file, so that lines keep their order and can be numbered
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.slice(F.filter(F.split("value", "\\r?\\n"), lambda x: F.trim(x) != ""), 2, 1 << 30)).alias("at", "line"))
    rows = lines.select("at", F.from_csv("line", ", ".join(f"c{i} string" for i in range(len(names)))).alias("r"))
    index = F.col(f"r.c{names.index('index')}").cast("int") if "index" in names else F.col("at")
    return rows.select(index.alias("index"), F.col(f"r.c{names.index(column)}").alias("name")).withColumn("group", class_group(F.col("name")))


def scrape_tracks(pages: DataFrame, key: str, html: str, row: str, artist: str, title: str) -> DataFrame:
    """key, at, artist, title of each page's rows, the first of equals (ignoring case).

    ``row``, ``artist`` and ``title`` are CSS selectors (``sources.selectors``); in a row the first element that fits
    counts, and a row without artist or title goes. A selector that can't be read is an error at once.
    """
    Rows(row, artist=artist, title=title)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, text in zip(frame[key], frame[html], strict=True):
                parser = Rows(row, artist=artist, title=title)
                parser.feed(text or "")
                for at, r in enumerate(parser.rows):
                    a, t = (" ".join(" ".join(r.get(c, ())).split()) for c in ("artist", "title"))
                    if a and t:
                        out.append((k, at, a, t))
            yield pd.DataFrame(out, columns=[key, "at", "artist", "title"])

    found = pages.select(key, html).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, at int, artist string, title string")
    again = F.row_number().over(W.partitionBy(key, F.lower("artist"), F.lower("title")).orderBy("at"))
    return found.withColumn("_n", again).where("_n = 1").drop("_n")


def first_seen(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key, in order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


#: The answer of the language model: what it may say, and how it must look.
CONTRACT = "class string, brand string, brand_mentions array<struct<name: string, type: string>>, commercial_signature struct<key_phrases: array<string>, duration_bucket_seconds: int>, confidence string, rationale string"


def parse_answers(df: DataFrame, column: str) -> DataFrame:
    """Adds ``answer`` (null if invalid) and ``valid`` for JSON answers.

    The class must be known, confidence empty or 0..1, mentions of known types, a signature's length 5..120
    seconds. Blank brands become null, blank phrases go, and so does a signature of what is no commercial.
    """
    from tidemark.schemas import CATEGORIES, MENTIONS

    j = F.from_json(F.col(column), CONTRACT)
    out = df.withColumn("_j", j)
    conf, sig = F.expr("try_cast(_j.confidence AS double)"), F.col("_j.commercial_signature")
    empty = F.coalesce(F.col("_j.confidence"), F.lit("")) == ""
    ok = F.col("_j.class").isin(*CATEGORIES) & (empty | conf.between(0.0, 1.0)) & (sig.isNull() | sig["duration_bucket_seconds"].between(5, 120))
    ok = ok & F.coalesce(F.forall("_j.brand_mentions", lambda m: m["name"].isNotNull() & m["type"].isin(*MENTIONS)), F.lit(True))
    phrases = F.filter(F.transform(F.coalesce(sig["key_phrases"], F.array().cast("array<string>")), lambda p: F.trim(p)), lambda p: p != "")
    kept = F.when((F.col("_j.class") == "COMMERCIAL") & sig.isNotNull(), F.struct(phrases.alias("key_phrases"), sig["duration_bucket_seconds"].alias("duration_bucket_seconds")))
    answer = F.struct(F.col("_j.class").alias("category"), F.when(F.trim("_j.brand") != "", F.col("_j.brand")).alias("brand"), F.coalesce("_j.brand_mentions", F.array().cast("array<struct<name: string, type: string>>")).alias("brand_mentions"), kept.alias("commercial_signature"), F.when(~empty, conf).alias("confidence"), F.col("_j.rationale").alias("rationale"))
    return out.withColumn("valid", F.coalesce(ok, F.lit(False))).withColumn("answer", F.when(F.col("valid"), answer)).drop("_j")


def call_model(df: DataFrame, key: Column, model: Callable[[list[str]], list[str]], column: str, answer: str = "answer_json", tries: int = 3) -> DataFrame:
    """Adds ``answer`` of a pluggable model, asked once for each distinct key, in batches, with retries."""
    import time

    asked = df.select(key.alias("_k"), F.col(column).alias("_text")).dropDuplicates(["_k"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n in range(tries):
                try:
                    said = model(frame["_text"].tolist())
                    break
                except Exception:
                    if n == tries - 1:
                        raise
                    time.sleep(0.25 * 2**n)
            yield pd.DataFrame({"_k": frame["_k"], answer: said})

    told = asked.mapInPandas(run, f"_k string, {answer} string")
    return df.withColumn("_k", key).join(told, "_k", "left").drop("_k")
