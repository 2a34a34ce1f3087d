"""The driver's tables seen as the broadcast schema: events as segments, parts as songs and ads, suppliers as brands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timewin import plus_seconds
from tidemark.schemas import Tables

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    e, p = read(spark, sf_dir, "events"), read(spark, sf_dir, "part")
    kind = F.col("event_type")
    category = F.when(kind == "view", "SONG").when(kind == "click", "COMMERCIAL").when(kind == "purchase", "DJ").when(kind == "signup", "STATION").otherwise("PSA_NEWS")
    n, user = F.col("event_id"), F.col("user_id")
    none = F.lit(None).cast("string")
    artist = F.concat(F.lit("Artist "), (user % 40).cast("string"))
    events = e.select(
        n.alias("id"),
        F.col("ts").alias("timestamp_start"),
        F.when(n % 7 != 0, plus_seconds(F.col("ts"), F.col("value"))).alias("timestamp_end"),
        F.col("value").alias("duration"),
        category.alias("category"),
        F.when((kind == "view") & (n % 11 != 0), user).alias("song_id"),
        F.when((kind == "click") & (n % 5 != 0), user).alias("commercial_id"),
        F.when(n % 3 == 0, user % 100).alias("brand_id"),
        F.when(n % 2 == 0, F.upper(artist)).otherwise(artist).alias("artist"),
        F.concat(F.lit("Title "), user.cast("string")).alias("track_title"),
        none.alias("brand_name"),
        F.when(n % 4 != 0, F.concat_ws(" ", F.lit("call now for"), kind, F.lit("and save"), (user % 9).cast("string"))).alias("transcript_excerpt"),
        (F.col("value") / 500).alias("confidence"),
        (n % 25).alias("capture_run_id"),
        F.col("ts").alias("created_at"),
    )
    source = F.when(F.col("p_size") % 3 == 0, "shazam").when(F.col("p_size") % 3 == 1, "audfprint").otherwise("manual")
    seen = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, p_size)")
    songs = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 1, F.col("p_name")).alias("audfprint_track_id"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"), source.alias("source"), seen.alias("first_seen_utc"), F.when(F.col("p_partkey") % 10 != 0, (1970 + F.col("p_size")).cast("string")).alias("release_date"))
    ads = p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100).alias("brand_id"), (F.col("p_size") * 5).alias("duration_bucket_seconds"), F.col("p_type").alias("minhash_hex"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("reference_transcript"), seen.alias("first_heard_utc"), F.col("p_size").cast("long").alias("play_count"))
    brands = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(n_nationkey as int))")
    runs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("run_id"), start.alias("started_utc"), F.when(F.col("n_regionkey") != 0, start + F.expr("interval 1 day")).alias("ended_utc"), F.lit("1").alias("pipeline_version"), none.alias("host"), none.alias("notes"), start.alias("created_at"))
    flag = F.col("l_returnflag")
    mentions = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("segment_id"), F.col("l_suppkey").alias("brand_id"), F.when(flag == "A", "paid_ad").when(flag == "N", "dj_shoutout").otherwise("tag").alias("mention_type"), F.col("l_shipdate").alias("heard_utc"))
    return Tables(brands, songs, ads, runs, events, mentions)


#: The same, as common table expressions.
SQL = """
ev AS (SELECT event_id AS id, ts AS timestamp_start,
    CASE WHEN event_id % 7 <> 0 THEN ts + to_microseconds(CAST(round(value * 1e6) AS BIGINT)) END AS timestamp_end, value AS duration,
    CASE event_type WHEN 'view' THEN 'SONG' WHEN 'click' THEN 'COMMERCIAL' WHEN 'purchase' THEN 'DJ' WHEN 'signup' THEN 'STATION' ELSE 'PSA_NEWS' END AS category,
    CASE WHEN event_type = 'view' AND event_id % 11 <> 0 THEN user_id END AS song_id,
    CASE WHEN event_type = 'click' AND event_id % 5 <> 0 THEN user_id END AS commercial_id,
    CASE WHEN event_id % 3 = 0 THEN user_id % 100 END AS brand_id,
    CASE WHEN event_id % 2 = 0 THEN upper('Artist ' || (user_id % 40)) ELSE 'Artist ' || (user_id % 40) END AS artist,
    'Title ' || user_id AS track_title, event_id % 25 AS capture_run_id, value / 500 AS confidence,
    CASE WHEN event_id % 4 <> 0 THEN 'call now for ' || event_type || ' and save ' || (user_id % 9) END AS transcript_excerpt
  FROM events),
songs AS (SELECT p_partkey AS id, p_brand AS artist, p_name AS title, CASE p_size % 3 WHEN 0 THEN 'shazam' WHEN 1 THEN 'audfprint' ELSE 'manual' END AS source,
    TIMESTAMP '2024-01-01' + to_hours(p_size) AS first_seen_utc, CASE WHEN p_partkey % 10 <> 0 THEN CAST(1970 + p_size AS VARCHAR) END AS release_date FROM part),
ads AS (SELECT p_partkey AS id, p_partkey % 100 AS brand_id, p_size * 5 AS duration_bucket_seconds, p_type AS minhash_hex,
    p_name || ' ' || p_type || ' ' || p_brand AS reference_transcript, CAST(p_size AS BIGINT) AS play_count FROM part),
brands AS (SELECT s_suppkey AS id, s_name AS canonical_name FROM supplier),
runs AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS run_id, TIMESTAMP '2024-01-01' + to_days(n_nationkey) AS started_utc,
    CASE WHEN n_regionkey <> 0 THEN TIMESTAMP '2024-01-01' + to_days(n_nationkey + 1) END AS ended_utc FROM nation),
mentions AS (SELECT l_suppkey AS brand_id, CASE l_returnflag WHEN 'A' THEN 'paid_ad' WHEN 'N' THEN 'dj_shoutout' ELSE 'tag' END AS mention_type, l_shipdate AS heard_utc FROM lineitem)
"""
