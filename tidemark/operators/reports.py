"""Reports over the broadcast schema. Every function returns a lazy DataFrame; top_n below 0 is an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.brands import canonicalize_brand
from tidemark.functions.text import normalize_token, once_each
from tidemark.functions.timewin import age_years, between, partial_date, span_seconds
from tidemark.operators.sessions import mode_first_seen, plays, spin_stats
from tidemark.schemas import Tables


def _top(n: int) -> int:
    if n < 0:
        raise ValueError("top_n must not be negative")
    return n


def _dur() -> Column:
    return F.coalesce(F.col("duration"), F.lit(0.0))


def _in(t: Tables, since, until, category: str | None = None) -> DataFrame:
    rows = t.events.where(between(F.col("timestamp_start"), since, until))
    return rows.where(F.col("category") == category) if category else rows


def summary(t: Tables, since=None, until=None) -> DataFrame:
    """category, events, airtime; the longest first."""
    out = _in(t, since, until).groupBy("category").agg(F.count(F.lit(1)).alias("events"), F.sum(_dur()).alias("airtime"))
    return out.orderBy(F.desc("airtime"), "category")


def hourly_mix(t: Tables, since=None, until=None) -> DataFrame:
    hour = F.date_format("timestamp_start", "yyyy-MM-dd'T'HH:00'Z'")
    return _in(t, since, until).groupBy(hour.alias("hour"), "category").agg(F.count(F.lit(1)).alias("events"), F.sum(_dur()).alias("airtime")).orderBy("hour", "category")


def dashboard_totals(t: Tables, since=None, until=None) -> DataFrame:
    """airtime, segments, song_share, ad_share; shares are 0 without airtime."""

    def share(category: str) -> Column:
        part = F.sum(F.when(F.col("category") == category, _dur()).otherwise(0.0))
        return F.coalesce(F.when(F.sum(_dur()) > 0, part / F.sum(_dur())), F.lit(0.0))

    return _in(t, since, until).agg(F.coalesce(F.sum(_dur()), F.lit(0.0)).alias("airtime"), F.count(F.lit(1)).alias("segments"), share("SONG").alias("song_share"), share("COMMERCIAL").alias("ad_share"))


def _ads(t: Tables, since, until, name=lambda c: c) -> DataFrame:
    ads = t.commercials.select(F.col("id").alias("commercial_id"), F.col("brand_id").alias("ad_brand_id"), "duration_bucket_seconds")
    brands = t.brands.select(F.col("id").alias("owner_id"), name(F.col("canonical_name")).alias("brand"))
    rows = _in(t, since, until, "COMMERCIAL").join(ads, "commercial_id", "left")
    return rows.withColumn("owner_id", F.coalesce("ad_brand_id", "brand_id")).join(brands, "owner_id", "left")


def commercials_top(t: Tables, since=None, until=None, top_n: int = 10, brand: str | None = None) -> DataFrame:
    """commercial_id, brand, duration_bucket_seconds, plays, last_heard, airtime."""
    rows = _ads(t, since, until)
    rows = rows.where(F.col("brand") == brand) if brand else rows
    out = rows.groupBy("commercial_id", "brand", "duration_bucket_seconds").agg(F.count(F.lit(1)).alias("plays"), F.max("timestamp_start").alias("last_heard"), F.sum(_dur()).alias("airtime"))
    return out.orderBy(F.desc("plays"), F.desc("airtime"), "commercial_id", "brand").limit(_top(top_n))


def commercials_by_brand(t: Tables, since=None, until=None, top_n: int = 25) -> DataFrame:
    """brand (canonical, null for unbranded), ads, plays, last_heard, airtime."""
    out = _ads(t, since, until, canonicalize_brand).groupBy("brand")  # names are canonicalised in the small table
    out = out.agg(F.count_distinct("commercial_id").alias("ads"), F.count(F.lit(1)).alias("plays"), F.max("timestamp_start").alias("last_heard"), F.sum(_dur()).alias("airtime"))
    return out.orderBy(F.desc("plays"), F.desc("airtime"), "brand").limit(_top(top_n))


def brands_top(t: Tables, since=None, until=None, top_n: int = 25) -> DataFrame:
    """brand, total, and a count for each kind of mention."""
    rows = t.mentions.where(between(F.col("heard_utc"), since, until)).join(t.brands.select(F.col("id").alias("brand_id"), F.col("canonical_name").alias("brand")), "brand_id")
    kinds = [F.count_if(F.col("mention_type") == k).alias(k) for k in ("paid_ad", "dj_shoutout", "tag")]
    return rows.groupBy("brand").agg(F.count(F.lit(1)).alias("total"), *kinds).orderBy(F.desc("total"), "brand").limit(_top(top_n))


def _songs(t: Tables, since, until) -> DataFrame:
    known = t.songs.select(F.col("id").alias("song_id"), F.col("artist").alias("s_artist"), F.col("title").alias("s_title"), "source", "release_date", "first_seen_utc")
    rows = _in(t, since, until, "SONG").join(known, "song_id", "left")
    return rows.withColumn("artist", F.coalesce("s_artist", "artist")).withColumn("title", F.coalesce("s_title", "track_title"))


def songs_top(t: Tables, since=None, until=None, top_n: int = 10, gap: float = 60.0) -> DataFrame:
    """song_id, artist, title, spins, promo_spins, full_spins, segments, airtime, full_airtime; ties by id, artist, title."""
    keys = ["song_id", "artist", "title"]
    out = spin_stats(_songs(t, since, until), keys, "timestamp_start", "timestamp_end", "duration", ["timestamp_start", "id"], gap, in_order=True)
    most = [F.desc(c) for c in ("full_spins", "full_airtime", "spins", "airtime", "segments")]
    return out.orderBy(*most, F.col("song_id").asc_nulls_last(), "artist", "title").limit(_top(top_n))


def _by_artist(t: Tables, since, until) -> DataFrame:
    rows = once_each(_songs(t, since, until), "artist", "artist_key", normalize_token).where("artist_key is not null")
    rows = once_each(rows.withColumn("_bare", F.when(F.col("song_id").isNull(), F.col("title"))), "_bare", "_key", normalize_token)
    return rows.withColumn("title_key", F.coalesce(F.col("song_id").cast("string"), "_key")).drop("_bare", "_key")


def artists_top(t: Tables, since=None, until=None, top_n: int = 10, gap: float = 60.0) -> DataFrame:
    """artist_key, artist (its most frequent spelling), spins summed over titles, titles, segments, airtimes."""
    rows = _by_artist(t, since, until)
    per = spin_stats(rows, ["artist_key", "title_key"], "timestamp_start", "timestamp_end", "duration", ["timestamp_start", "id"], gap, in_order=True)
    sums = [F.sum(c).alias(c) for c in ("spins", "promo_spins", "full_spins", "segments", "airtime", "full_airtime")]
    out = per.groupBy("artist_key").agg(F.count("title_key").alias("titles"), *sums).join(mode_first_seen(rows, ["artist_key"], "artist", ["timestamp_start", "id"]), "artist_key")
    most = [F.desc(c) for c in ("full_spins", "full_airtime", "spins", "airtime", "segments")]
    return out.orderBy(*most, "artist_key").limit(_top(top_n))


def top_artist_playlogs(t: Tables, since=None, until=None, top_n: int = 3, gap: float = 60.0) -> DataFrame:
    """Every play of the top artists: rank (from 0), artist, title, play_start, play_end, play_seconds, is_promo."""
    top = artists_top(t, since, until, top_n, gap).select("artist_key", F.col("artist").alias("shown"), "full_spins", "full_airtime", "spins", "airtime", "segments")
    order = W.orderBy(*[F.desc(c) for c in ("full_spins", "full_airtime", "spins", "airtime", "segments")], "artist_key")
    top = top.withColumn("rank", F.row_number().over(order) - 1).select("artist_key", "shown", "rank")  # top_n rows
    rows = _by_artist(t, since, until).join(top, "artist_key")
    name = mode_first_seen(rows, ["artist_key", "title_key"], "title", ["timestamp_start", "id"])
    out = plays(rows, ["artist_key", "title_key", "shown", "rank"], "timestamp_start", "timestamp_end", "duration", ["timestamp_start", "id"], gap, in_order=True)
    out = out.join(name.withColumnRenamed("artist_key", "_a").withColumnRenamed("title_key", "_t"), F.col("artist_key").eqNullSafe(F.col("_a")) & F.col("title_key").eqNullSafe(F.col("_t")))
    return out.select("rank", F.col("shown").alias("artist"), "title", "play_start", "play_end", "play_seconds", "segments", "is_promo").orderBy("rank", "play_start", "title")


def songs_timeline(t: Tables, since=None, until=None, limit: int = 500) -> DataFrame:
    rows = _songs(t, since, until).select("timestamp_start", "timestamp_end", "duration", "artist", "title", F.coalesce("source", F.lit("unknown")).alias("source"), "confidence", "id")
    return rows.orderBy("timestamp_start", "id").limit(_top(limit))


def timeline(t: Tables, since=None, until=None, limit: int = 500) -> DataFrame:
    """All events in order, with what to show: artist and title of songs, brand of the rest."""
    brands = t.brands.select(F.col("id").alias("brand_id"), F.col("canonical_name").alias("known_brand"))
    songs = t.songs.select(F.col("id").alias("song_id"), F.col("artist").alias("s_artist"), F.col("title").alias("s_title"))
    rows = _in(t, since, until).join(brands, "brand_id", "left").join(songs, "song_id", "left")
    shown = (F.coalesce("s_artist", "artist").alias("artist"), F.coalesce("s_title", "track_title").alias("title"), F.coalesce("known_brand", "brand_name").alias("brand"))
    return rows.select("id", "timestamp_start", "timestamp_end", "duration", "category", *shown, "transcript_excerpt", "confidence").orderBy("timestamp_start", "id").limit(_top(limit))


def songs_added(t: Tables, since=None, until=None, source: str | None = None, top_n: int = 50) -> DataFrame:
    """Songs first seen in the window, latest first; spin_count counts their events in it, of any category."""
    new = t.songs.where(between(F.col("first_seen_utc"), since, until))
    new = new.where(F.col("source") == source) if source else new
    heard = _in(t, since, until).groupBy("song_id").agg(F.count(F.lit(1)).alias("n")).where("song_id is not null")
    out = new.join(heard, new["id"] == heard["song_id"], "left").select("id", "artist", "title", "source", "first_seen_utc", F.coalesce("n", F.lit(0)).alias("spin_count"))
    return out.orderBy(F.desc("first_seen_utc"), F.desc("id")).limit(_top(top_n))


def runs_summary(t: Tables, top_n: int = 50) -> DataFrame:
    n = t.events.groupBy(F.col("capture_run_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    out = t.capture_runs.join(n, "id", "left").withColumn("events", F.coalesce("n", F.lit(0))).withColumn("run_seconds", span_seconds(F.col("started_utc"), F.col("ended_utc")))
    return out.drop("n").orderBy(F.desc("started_utc"), F.desc("id")).limit(_top(top_n))


def song_age_stats(t: Tables, reference, since=None, until=None) -> DataFrame:
    """songs, dated, missing; mean and median age over distinct songs; mean weighted by airtime; null if none is dated."""
    per = _in(t, since, until, "SONG").join(t.songs.select(F.col("id").alias("song_id"), "release_date"), "song_id").groupBy("song_id", "release_date").agg(F.sum(_dur()).alias("airtime"))
    per = per.withColumn("age", age_years(partial_date(F.col("release_date")), F.lit(reference).cast("date")))
    weight = F.sum(F.when(F.col("age").isNotNull(), F.col("airtime")))
    return per.agg(F.count(F.lit(1)).alias("songs"), F.count("age").alias("dated"), F.count_if(F.col("age").isNull()).alias("missing"), F.avg("age").alias("mean_age"), F.median("age").alias("median_age"), F.when(weight > 0, F.sum(F.col("age") * F.col("airtime")) / weight).alias("weighted_age"))


def discoveries(t: Tables, tracklist: DataFrame | None = None, since=None, top_n: int = 50, min_plays: int = 0, only_new: bool = False, review_below: int = 3) -> DataFrame:
    """Songs that only the external service knows, by plays. The limit comes first, then min_plays and only_new."""
    from tidemark.functions.text import tracklist_key

    new = t.songs.where("source = 'shazam'")
    heard = _in(t, since, None).groupBy("song_id").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp_start").alias("last_heard"))
    out = new.join(heard, new["id"] == heard["song_id"], "left").select("id", "artist", "title", "first_seen_utc", F.coalesce("n", F.lit(0)).alias("plays"), "last_heard")
    out = out.orderBy(F.desc("plays"), F.desc("last_heard"), F.desc("first_seen_utc"), "id").limit(max(1, top_n))
    out = out.withColumn("needs_review", F.col("plays") < review_below)
    if tracklist is not None:
        listed = tracklist.select(tracklist_key(F.col("artist")).alias("_a"), tracklist_key(F.col("title")).alias("_t")).where("_a is not null or _t is not null").distinct().withColumn("_in", F.lit(True))
        out = out.withColumn("_x", tracklist_key(F.col("artist"))).withColumn("_y", tracklist_key(F.col("title")))
        out = out.join(listed, F.col("_x").eqNullSafe(F.col("_a")) & F.col("_y").eqNullSafe(F.col("_t")), "left")
        out = out.withColumn("in_tracklist", F.coalesce("_in", F.lit(False))).drop("_x", "_y", "_a", "_t", "_in")
        out = out.where("not in_tracklist") if only_new else out
    return out.where(F.col("plays") >= min_plays)


def event_at(t: Tables, points: DataFrame, at: str = "at") -> DataFrame:
    """Each point in time with the event that covers it; of several the one that starts last."""
    from tidemark.functions.timewin import as_of

    return as_of(points, t.events, at, "timestamp_start", "timestamp_end", "id")


def recall(checked: DataFrame, truth: str = "truth", found: str = "found") -> DataFrame:
    """correct, total and recall of labels, compared by key; 0 without rows."""
    from tidemark.functions.text import label_key

    ok = F.coalesce(label_key(F.col(truth)) == label_key(F.col(found)), F.lit(False))
    return checked.agg(F.count_if(ok).alias("correct"), F.count(F.lit(1)).alias("total"), F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("recall"))


def captured_seconds(sidecars: DataFrame) -> DataFrame:
    """Whole seconds of all sidecars; what can't be read counts as 0."""
    return sidecars.agg(F.coalesce(F.sum(F.coalesce(F.floor(F.expr("try_cast(duration_seconds AS double)")), F.lit(0))), F.lit(0)).alias("seconds"))


def class_rollup(scores: DataFrame, window: str = "window_id", score: str = "scores", group: str = "groups", names: str = "names") -> DataFrame:
    """Frames' class scores (an array each) -> per window the shares of music, speech and other, and the top 5 classes.

    ``group`` and ``names`` are arrays parallel to the scores. Means are clipped to 0..1 and normalised.
    """
    each = scores.select(window, F.posexplode(F.arrays_zip(F.col(score).alias("s"), F.col(group).alias("g"), F.col(names).alias("n"))).alias("pos", "x"))
    mean = each.groupBy(window, "pos", F.col("x.g").alias("g"), F.col("x.n").alias("n")).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("x.s"))).alias("m"))
    mass = {k: F.sum(F.when(F.col("g") == k, F.col("m")).otherwise(0.0)) for k in ("music", "speech", "other")}
    total = mass["music"] + mass["speech"] + mass["other"]
    shares = [F.when(total > 0, m / total).otherwise(1 / 3).alias(f"{k}_prob") for k, m in mass.items()]
    top = F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("k"), "pos", F.col("n").alias("name"), F.col("m").alias("prob")))), lambda x: F.struct(x["name"].alias("name"), x["prob"].alias("prob"))), 1, 5)
    return mean.groupBy(window).agg(*shares, top.alias("top_classes"))
