"""Repairs: each is a plan, a DataFrame to look at, and an apply that returns new tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.brands import ALIASES, brand_key, canonicalize_brand, extract_brand
from tidemark.functions.text import ARTIST_ALIASES, once_each, prefer_display, song_artist_key, song_title_key, text_similarity, tracklist_key
from tidemark.functions.timewin import between, earliest_date, span_seconds
from tidemark.operators.resolve import components, counts_of, cut, dropped, repoint, resolve_commercials, survivors, table
from tidemark.operators.sessions import neighbours, stitch_runs
from tidemark.operators.simjoin import similar_pairs, spanning_links
from tidemark.schemas import Tables

# ---- ids and upserts


def next_ids(new: DataFrame, table: DataFrame, order: list[str], slot: Column | None = None) -> DataFrame:
    """``new`` with ids after those of ``table``, in order.

    Rows are ordered within slots, which must rise with the first column of the order: its first two
    characters unless given (the day of a time, say). The counts of slots, a row each, are added up.
    """
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    rows = new.withColumn("_slot", F.substring(F.col(order[0]).cast("string"), 1, 2) if slot is None else slot)
    ahead = F.coalesce(F.sum("_n").over(W.orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slots = rows.groupBy(F.col("_slot").alias("_of")).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("_of", "_slot").select(F.col("_slot").alias("_of"), ahead.alias("_ahead"))
    rows = rows.withColumn("_nr", F.row_number().over(W.partitionBy("_slot").orderBy(*order))).join(slots, F.col("_slot").eqNullSafe(F.col("_of")))
    return rows.join(F.broadcast(top)).withColumn("id", F.col("_nr") + F.col("_ahead") + F.col("_top")).select(*[c for c in new.columns if c != "id"], "id")  # one row


def upsert_brands(t: Tables, names: DataFrame, now) -> Tables:
    """Adds the canonical names of ``names`` (name) that no brand has yet."""
    new = names.select(canonicalize_brand(F.col("name")).alias("canonical_name")).where("canonical_name is not null").distinct()
    new = next_ids(new.join(t.brands, "canonical_name", "left_anti"), t.brands, ["canonical_name"])
    new = new.withColumn("aliases", F.array().cast("array<string>")).withColumn("created_at", F.lit(now).cast("timestamp"))
    return t.having(brands=t.brands.unionByName(new.select(*t.brands.columns)))


def upsert_songs(t: Tables, heard: DataFrame, now) -> Tables:
    """Adds or completes songs from ``heard`` (seq, artist, title, audfprint_track_id, source).

    Songs are one if their artist and title keys are. The lowest id keeps its row, takes a track id it
    lacks, becomes audfprint if shazam found it first, and takes the better spelling, in order of seq.
    """
    keyed = [F.array(song_artist_key(F.col("artist"), F.col("title")), song_title_key(F.col("title"))).alias("k")]
    old = t.songs.select("*", *keyed)
    first = old.groupBy("k").agg(F.min("id").alias("id"))
    new = heard.select("*", *keyed)
    # a report that repeats an earlier one changes nothing, so the first of each kind stands for all: a song heard very
    # often brings as many rows as it has spellings, which meet one after another, in order
    told = ["artist", "title", "audfprint_track_id", "source"]
    new = new.groupBy("k", *told).agg(F.min("seq").alias("seq"))
    report = F.struct("seq", *told)
    batch = new.groupBy("k").agg(F.array_sort(F.collect_list(report)).alias("reports"))
    joined = batch.join(first, "k", "left").join(t.songs, "id", "left")
    start = F.when(F.col("source").isNotNull(), F.struct("artist", "title", "audfprint_track_id", "source")).otherwise(F.transform(F.slice("reports", 1, 1), lambda r: F.struct(r["artist"].alias("artist"), r["title"].alias("title"), r["audfprint_track_id"].alias("audfprint_track_id"), r["source"].alias("source")))[0])

    def step(s, r):
        return F.struct(
            prefer_display(s["artist"], r["artist"], ARTIST_ALIASES).alias("artist"),
            prefer_display(s["title"], r["title"], None, song_title_key).alias("title"),
            F.coalesce(s["audfprint_track_id"], r["audfprint_track_id"]).alias("audfprint_track_id"),
            F.when((s["source"] == "shazam") & (r["source"] == "audfprint"), "audfprint").otherwise(s["source"]).alias("source"),
        )

    done = joined.select("id", "first_seen_utc", "release_date", F.aggregate("reports", start, step).alias("s")).select("id", "first_seen_utc", "release_date", "s.*")
    changed = done.where("id is not null")
    fresh = next_ids(done.where("id is null").drop("id"), t.songs, ["artist", "title"]).withColumn("first_seen_utc", F.lit(now).cast("timestamp"))
    kept = t.songs.join(changed.select("id"), "id", "left_anti").select(*t.songs.columns)
    return t.having(songs=kept.unionByName(changed.select(*t.songs.columns)).unionByName(fresh.select(*t.songs.columns)))


def open_runs(t: Tables, runs: DataFrame) -> Tables:
    """Adds runs whose run_id is new; those that are there already stay as they are."""
    new = next_ids(runs.join(t.capture_runs, "run_id", "left_anti").dropDuplicates(["run_id"]), t.capture_runs, ["run_id"])
    return t.having(capture_runs=t.capture_runs.unionByName(new.select(*t.capture_runs.columns)))


def close_runs(t: Tables, ends: DataFrame) -> Tables:
    """Sets the end, and notes where given, of runs by run_id."""
    out = t.capture_runs.join(ends.select("run_id", F.col("ended_utc").alias("_e"), F.col("notes").alias("_n")), "run_id", "left")
    out = out.withColumn("ended_utc", F.coalesce("_e", "ended_utc")).withColumn("notes", F.coalesce("_n", "notes"))
    return t.having(capture_runs=out.select(*t.capture_runs.columns))


def append_segments(t: Tables, segments: DataFrame, run_id=None, now=None) -> Tables:
    """Adds segments as events, with duration and the id of a known brand name."""
    brands = t.brands.select(F.col("id").alias("brand_id"), F.col("canonical_name").alias("_name"))
    out = once_each(segments, "brand_name", "_canonical", canonicalize_brand).join(brands, F.col("_canonical") == F.col("_name"), "left").drop("_canonical", "_name")
    out = next_ids(out, t.events, ["timestamp_start", "timestamp_end"], F.to_date("timestamp_start")).withColumn("duration", span_seconds(F.col("timestamp_start"), F.col("timestamp_end")))
    out = out.withColumn("capture_run_id", F.lit(run_id).cast("long")).withColumn("created_at", F.lit(now).cast("timestamp"))
    return t.having(events=t.events.unionByName(out.select(*t.events.columns)))


def attach_mentions(t: Tables, mentions: DataFrame, now=None) -> Tables:
    """Mentions (name, mention_type, heard_utc) go to the event that covers them and to their brand, which is added if it is new."""
    from tidemark.functions.timewin import as_of

    t = upsert_brands(t, mentions.select("name"), now)
    named = once_each(mentions, "name", "canonical_name", canonicalize_brand).join(t.brands.select(F.col("id").alias("brand_id"), "canonical_name"), "canonical_name")
    spans = t.events.select(F.col("id").alias("segment_id"), "timestamp_start", "timestamp_end")
    out = as_of(named.select("brand_id", "mention_type", "heard_utc"), spans, "heard_utc", "timestamp_start", "timestamp_end", "segment_id")
    out = next_ids(out, t.mentions, ["heard_utc", "brand_id", "mention_type"], F.to_date("heard_utc"))
    return t.having(mentions=t.mentions.unionByName(out.select(*t.mentions.columns)))


def delete_events(t: Tables, gone: DataFrame) -> Tables:
    """Without the events of ``gone`` (id), nor mentions of them."""
    return t.having(events=t.events.join(gone, "id", "left_anti").select(*t.events.columns), mentions=t.mentions.join(gone.select(F.col("id").alias("segment_id")), "segment_id", "left_anti").select(*t.mentions.columns))


# ---- songs


def plan_song_dedupe(t: Tables) -> DataFrame:
    """(loser_id, survivor_id) of songs with equal keys. Rows with a track id, from audfprint, with more events, older survive."""
    n = counts_of(t.events, "song_id", "n")
    rows = t.songs.withColumn("ka", song_artist_key(F.col("artist"), F.col("title"))).withColumn("kt", song_title_key(F.col("title"))).where("ka <> '' and kt <> ''")
    rows = rows.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return survivors(rows, ["ka", "kt"], "id", [F.col("audfprint_track_id").isNull(), F.col("source") != "audfprint", F.desc("n"), F.col("id")])


def dedupe_songs(t: Tables, plan: DataFrame | None = None) -> Tables:
    plan = plan_song_dedupe(t) if plan is None else plan
    return t.having(events=repoint(t.events, "song_id", plan), songs=dropped(t.songs, plan))


def plan_stitch(t: Tables, since=None, until=None, most: float = 2.0, by: list[str] | None = None) -> DataFrame:
    """Plays that capture blocks have cut: survivor, members, end, confidence, cross_run."""
    rows = t.events.where((F.col("category") == "SONG") & between(F.col("timestamp_start"), since, until))
    return stitch_runs(rows, by or [], "song_id", "timestamp_start", "timestamp_end", "id", "confidence", "capture_run_id", most)


def stitch(t: Tables, plan: DataFrame) -> Tables:
    kept = plan.select(F.col("survivor").alias("id"), F.col("end").alias("_end"), F.col("confidence").alias("_c"))
    gone = plan.select("survivor", F.explode("members").alias("id")).where("id <> survivor").select("id")
    events = t.events.join(kept, "id", "left").withColumn("timestamp_end", F.coalesce("_end", "timestamp_end"))
    events = events.withColumn("duration", F.when(F.col("_end").isNotNull(), span_seconds(F.col("timestamp_start"), F.col("_end"))).otherwise(F.col("duration")))
    events = events.withColumn("confidence", F.coalesce("_c", "confidence")).select(*t.events.columns)
    return delete_events(t.having(events=events), gone)


def plan_promotions(t: Tables, song_ids: DataFrame, tracklist: DataFrame) -> DataFrame:
    """(at, song_id, artist, title, reason): reason says why a song can't join the tracklist; null: it can."""
    listed = tracklist.select(tracklist_key(F.col("artist")).alias("la"), tracklist_key(F.col("title")).alias("lt")).distinct().withColumn("_listed", F.lit(True))
    rows = song_ids.select("at", "song_id").join(t.songs.select(F.col("id").alias("song_id"), "artist", "title", "source", F.lit(True).alias("_there")), "song_id", "left")
    rows = rows.withColumn("ka", tracklist_key(F.col("artist"))).withColumn("kt", tracklist_key(F.col("title")))
    rows = rows.join(listed, F.col("ka").eqNullSafe(F.col("la")) & F.col("kt").eqNullSafe(F.col("lt")), "left")
    why = F.when(F.col("_there").isNull(), "not found").when(F.col("source") != "shazam", "source").when((F.coalesce("artist", F.lit("")) == "") | (F.coalesce("title", F.lit("")) == ""), "missing artist or title").when(F.col("_listed"), "already in tracklist")
    rows = rows.withColumn("reason", why)
    again = F.row_number().over(W.partitionBy("ka", "kt", F.col("reason").isNull()).orderBy("at")) > 1
    return rows.withColumn("reason", F.when(F.col("reason").isNull() & again, "duplicate in this call").otherwise(F.col("reason"))).select("at", "song_id", "artist", "title", "reason")


def enrich_releases(t: Tables, found: DataFrame, since=None, until=None) -> tuple[Tables, DataFrame]:
    """Release dates from ``found`` (song_id, first_release, release_dates) for songs heard in the window that lack one.

    The second result counts examined, updated, skipped_existing and not_found.
    """
    heard = t.events.where(between(F.col("timestamp_start"), since, until)).select(F.col("song_id").alias("id"))
    dates = found.select(F.col("song_id").alias("id"), earliest_date(F.col("first_release"), F.col("release_dates")).cast("string").alias("_date"))
    rows = t.songs.join(heard, "id", "left_semi").join(dates, "id", "left")
    told = rows.agg(F.count(F.lit(1)).alias("examined"), F.count_if(F.col("release_date").isNotNull()).alias("skipped_existing"), F.count_if(F.col("release_date").isNull() & F.col("_date").isNotNull()).alias("updated"), F.count_if(F.col("release_date").isNull() & F.col("_date").isNull()).alias("not_found"))
    new = rows.where("release_date is null and _date is not null").select("id", "_date")
    songs = t.songs.join(new, "id", "left").withColumn("release_date", F.coalesce("release_date", "_date")).select(*t.songs.columns)
    return t.having(songs=songs), told


# ---- commercials


def _ads(t: Tables) -> DataFrame:
    brands = t.brands.select(F.col("id").alias("brand_id"), F.col("canonical_name").alias("brand"), F.coalesce(brand_key(F.col("canonical_name")), F.lit("")).alias("owner")).hint("merge")
    n = counts_of(t.events, "commercial_id", "events")
    return t.commercials.join(brands, "brand_id").join(n, "id", "left").withColumn("events", F.coalesce("events", F.lit(0)))


def commercial_links(t: Tables, similar: float = 0.55, adjacent: float = 0.35, gap: float = 10.0, each: float = 30.0, joint: float = 90.0, spanning: bool = False) -> DataFrame:
    """(owner, a, b, reason, similarity): ads of a brand and length with like texts, and neighbours in time that one ad was cut into.

    With ``spanning``, links of similar texts are only as many as connect the same ads, without a similarity.
    """
    ads = _ads(t)
    block = ["owner", "duration_bucket_seconds"]
    if spanning:
        alike = spanning_links(ads, block, "id", "reference_transcript", similar).withColumn("similarity", F.lit(None).cast("double"))
    else:
        alike = similar_pairs(ads, block, "id", "reference_transcript", similar)
    owner = ads.select(F.col("id").alias("a"), "owner")
    alike = alike.join(owner, "a").select("owner", "a", "b", F.lit("similar").alias("reason"), "similarity")
    heard = t.events.where("category = 'COMMERCIAL' and commercial_id is not null and timestamp_end is not null")
    heard = heard.join(ads.select(F.col("id").alias("commercial_id"), "owner"), "commercial_id").withColumn("text", F.coalesce("transcript_excerpt", F.lit("")))
    heard = heard.withColumn("seconds", F.coalesce("duration", span_seconds(F.col("timestamp_start"), F.col("timestamp_end"))))
    cols = ["commercial_id", "owner", "text", "timestamp_end", "seconds"]
    near = neighbours(heard, cols, ["timestamp_start", "id"], []).where("prev is not null")
    between_ = F.greatest(F.lit(0.0), span_seconds(F.col("prev.timestamp_end"), F.col("timestamp_start")))
    ok = (F.col("prev.owner") == F.col("owner")) & (F.col("prev.commercial_id") != F.col("commercial_id")) & (F.col("prev.seconds") <= each) & (F.col("seconds") <= each) & (F.col("prev.seconds") + F.col("seconds") <= joint) & (between_ <= gap)
    near = near.where(ok).withColumn("similarity", text_similarity(F.col("prev.text"), F.col("text"))).where(F.col("similarity") >= adjacent)
    near = near.select("owner", F.least("prev.commercial_id", "commercial_id").alias("a"), F.greatest("prev.commercial_id", "commercial_id").alias("b"), F.lit("adjacent").alias("reason"), "similarity")
    return alike.unionByName(near)


def plan_commercial_dedupe(t: Tables, **options) -> DataFrame:
    """(loser_id, survivor_id, reasons): linked ads fold into the one with most events, then the first brand name, then id."""
    links = table(commercial_links(t, spanning=True, **options)).hint("merge")
    groups = components(links)
    rows = groups.select(F.col("node").alias("id"), "root").join(_ads(t), "id")
    moved = survivors(rows, ["root"], "id", [F.desc("events"), F.lower("brand"), F.col("id")])
    why = links.join(groups.select(F.col("node").alias("a"), "root"), "a").groupBy("root").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    return moved.join(groups.select(F.col("node").alias("loser_id"), "root"), "loser_id").join(why, "root").select("loser_id", "survivor_id", "reasons")


def dedupe_commercials(t: Tables, plan: DataFrame, sum_play_count: bool = False) -> Tables:
    """Events go to the surviving ad and its brand; mentions of those events follow. Play counts add up only if asked."""
    ads = dropped(t.commercials, plan)
    if sum_play_count:
        more = t.commercials.join(plan.select(F.col("loser_id").alias("id"), "survivor_id"), "id").groupBy(F.col("survivor_id").alias("id")).agg(F.sum("play_count").alias("_more"))
        ads = ads.join(more, "id", "left").withColumn("play_count", F.col("play_count") + F.coalesce("_more", F.lit(0))).select(*t.commercials.columns)
    owner = t.commercials.select(F.col("id").alias("survivor_id"), F.col("brand_id").alias("_brand"))
    to = plan.select("loser_id", "survivor_id").join(owner, "survivor_id")
    events = t.events.join(to, t.events["commercial_id"] == to["loser_id"], "left").withColumn("commercial_id", F.coalesce("survivor_id", "commercial_id")).withColumn("brand_id", F.coalesce("_brand", "brand_id")).select(*t.events.columns)
    return t.having(events=events, commercials=ads)


def plan_boundaries(t: Tables, since=None, until=None, similar: float = 0.55, gap: float = 12.0) -> DataFrame:
    """Unbranded ad rows that continue a branded neighbour: event_id, side, commercial_id, brand_id, brand_name, similarity.

    Neighbours are the rows just before and after, of any category; one pass, no cascade.
    """
    rows = t.events.where(between(F.col("timestamp_start"), since, until)).join(t.brands.select(F.col("id").alias("brand_id"), F.col("canonical_name").alias("_name")), "brand_id", "left")
    rows = rows.withColumn("shown", F.coalesce("_name", "brand_name")).withColumn("text", F.coalesce("transcript_excerpt", F.lit("")))
    cols = ["category", "commercial_id", "brand_id", "shown", "text", "timestamp_start", "timestamp_end"]
    rows = neighbours(rows, cols, ["timestamp_start", "id"], [])
    bare = F.col("commercial_id").isNull() & F.col("brand_id").isNull() & (F.coalesce("brand_name", F.lit("")) == "")
    rows = rows.where((F.col("category") == "COMMERCIAL") & bare & (F.trim("text") != ""))

    def side(n: str, apart):
        branded = (F.col(f"{n}.category") == "COMMERCIAL") & (F.col(f"{n}.brand_id").isNotNull() | F.col(f"{n}.commercial_id").isNotNull())
        return F.when(branded & (apart <= gap), text_similarity(F.col("text"), F.col(f"{n}.text")))

    before = F.greatest(F.lit(0.0), F.coalesce(span_seconds(F.col("prev.timestamp_end"), F.col("timestamp_start")), F.lit(0.0)))
    after = F.greatest(F.lit(0.0), F.coalesce(span_seconds(F.col("timestamp_end"), F.col("next.timestamp_start")), F.lit(0.0)))
    rows = rows.withColumn("_p", side("prev", before)).withColumn("_n", side("next", after))
    first = F.col("_p").isNotNull() & (F.col("_n").isNull() | (F.col("_p") >= F.col("_n")))
    rows = rows.withColumn("side", F.when(first, "prev").otherwise("next")).withColumn("similarity", F.greatest("_p", "_n")).where(F.col("similarity") >= similar)
    chosen = F.when(first, F.col("prev")).otherwise(F.col("next"))
    return rows.select(F.col("id").alias("event_id"), "side", chosen["commercial_id"].alias("commercial_id"), chosen["brand_id"].alias("brand_id"), chosen["shown"].alias("brand_name"), "similarity")


def fill_brands(t: Tables, plan: DataFrame) -> Tables:
    """Events of ``plan`` (event_id, commercial_id, brand_id, brand_name) take what they lack."""
    new = plan.select(F.col("event_id").alias("id"), F.col("commercial_id").alias("_c"), F.col("brand_id").alias("_b"), F.col("brand_name").alias("_n"))
    out = t.events.join(new, "id", "left").withColumn("commercial_id", F.coalesce("commercial_id", "_c")).withColumn("brand_id", F.coalesce("brand_id", "_b"))
    out = out.withColumn("brand_name", F.coalesce(F.when(F.col("brand_name") != "", F.col("brand_name")), F.col("_n"), F.col("brand_name")))
    return t.having(events=out.select(*t.events.columns))


def plan_backfill(t: Tables, since=None, until=None, limit: int | None = None, classify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(event_id, brand_name, source, transcript, seconds, heard_utc) of unbranded ads whose transcript names a brand.

    source is deterministic where the extractor finds it. The others, if ``classify`` is given, go to that: it takes
    (event_id, transcript) and returns (event_id, category, brand), which counts if the category is COMMERCIAL; source is llm.
    """
    rows = t.events.where((F.col("category") == "COMMERCIAL") & between(F.col("timestamp_start"), since, until))
    rows = rows.where(F.col("commercial_id").isNull() & F.col("brand_id").isNull() & (F.coalesce("brand_name", F.lit("")) == "") & (F.trim("transcript_excerpt") != ""))
    rows = rows.orderBy("timestamp_start", "id").limit(limit) if limit is not None else rows
    found = rows.select(F.col("id").alias("event_id"), extract_brand(F.col("transcript_excerpt")).alias("brand_name"), F.lit("deterministic").alias("source"), F.col("transcript_excerpt").alias("transcript"), F.coalesce("duration", F.lit(0.0)).alias("seconds"), F.col("timestamp_start").alias("heard_utc"))
    if classify is not None:
        told = cut(classify(found.where("brand_name is null").select("event_id", "transcript")).select("event_id", "category", "brand"))
        told = told.where("category = 'COMMERCIAL'").select("event_id", canonicalize_brand(F.col("brand")).alias("_brand"))
        found = found.join(told, "event_id", "left").withColumn("source", F.when(F.col("brand_name").isNull(), "llm").otherwise(F.col("source"))).withColumn("brand_name", F.coalesce("brand_name", "_brand")).drop("_brand")
    return found.where("brand_name is not null")


def backfill_brands(t: Tables, plan: DataFrame, now) -> Tables:
    """Adds the brands a backfill plan names, resolves its ads, and links events to both.

    In order of time each event finds its ad among those of its brand and length, or becomes one; out of the range of
    lengths it has a brand only. Each event becomes a paid mention of its brand at its start.
    """
    plan = cut(plan)
    t = upsert_brands(t, plan.select(F.col("brand_name").alias("name")), now)
    brands = t.brands.select(F.col("id").alias("brand_id"), F.col("canonical_name").alias("brand"))
    # numbers after those of the ads, as windows that become ads are named by theirs
    heard = cut(next_ids(plan, t.commercials, ["heard_utc", "event_id"], F.to_date("heard_utc")).withColumnRenamed("id", "seq"))
    windows = heard.select("seq", F.col("brand_name").alias("brand"), "transcript", F.col("seconds").alias("duration_seconds"), F.array().cast("array<string>").alias("key_phrases"))
    known = t.commercials.join(brands, "brand_id").select(F.col("id").alias("ad"), "brand", F.col("duration_bucket_seconds").alias("bucket"), "minhash_hex", F.col("reference_transcript").alias("transcript"))
    t, told = store_resolved(t, cut(resolve_commercials(windows, known.where("length(minhash_hex) = 2048"))), now)
    named = heard.join(told, "seq", "left").join(brands.withColumnRenamed("brand", "brand_name"), "brand_name")
    said = next_ids(named.select(F.col("event_id").alias("segment_id"), "brand_id", F.lit("paid_ad").alias("mention_type"), "heard_utc"), t.mentions, ["heard_utc", "segment_id"], F.to_date("heard_utc"))
    return fill_brands(t, named.select("event_id", "commercial_id", "brand_id", "brand_name")).having(mentions=t.mentions.unionByName(said.select(*t.mentions.columns)))


def store_resolved(t: Tables, resolved: DataFrame, now) -> tuple[Tables, DataFrame]:
    """What resolve_commercials told, kept: new ads become rows, and every match of an ad raises its play count.

    ``resolved`` is its result, with ``known`` the ads of these tables. The second result is (seq,
    commercial_id) of all windows that have an ad.
    """
    live = resolved.where(F.col("outcome").isin("matched", "inserted"))
    heard = live.groupBy("ad").agg(F.count(F.lit(1)).alias("_n"))
    fresh = live.where("outcome = 'inserted'").join(heard, "ad").join(t.brands.select(F.col("id").alias("brand_id"), F.col("canonical_name").alias("brand")), "brand")
    fresh = fresh.select("ad", "brand_id", F.col("bucket").cast("int").alias("duration_bucket_seconds"), "minhash_hex", F.col("transcript").alias("reference_transcript"), F.lit(now).cast("timestamp").alias("first_heard_utc"), F.col("_n").alias("play_count"))
    fresh = next_ids(fresh, t.commercials, ["ad"], F.floor(F.col("ad") / 100_000))
    made = live.where("outcome = 'inserted'").select("ad").distinct()
    old = heard.join(made, "ad", "left_anti").select(F.col("ad").alias("id"), "_n")
    ads = t.commercials.join(old, "id", "left").withColumn("play_count", F.col("play_count") + F.coalesce("_n", F.lit(0))).select(*t.commercials.columns)
    named = live.select("seq", "ad").join(fresh.select("ad", F.col("id").alias("_id")), "ad", "left").join(made.withColumn("_new", F.lit(True)), "ad", "left")
    told = named.select("seq", F.when(F.col("_new"), F.col("_id")).otherwise(F.col("ad")).alias("commercial_id"))
    return t.having(commercials=ads.unionByName(fresh.select(*t.commercials.columns))), told


def repair_report(items: DataFrame, brand: str = "brand_name", source: str | None = None, similarity: str | None = None) -> DataFrame:
    """A plan's rows by brand, the most first: events, and where given their sources and least and greatest similarity."""
    more = [F.array_join(F.sort_array(F.collect_set(source)), "+").alias("sources")] * (source is not None)
    more += [f(similarity).alias(n) for f, n in ((F.min, "least"), (F.max, "greatest"))] if similarity else []
    return items.groupBy(F.col(brand).alias("brand")).agg(F.count(F.lit(1)).alias("events"), *more).orderBy(F.desc("events"), "brand")


def progress(routed: DataFrame) -> DataFrame:
    """How many of the funnel's windows became each category, every category in a row; those without segment input are UNKNOWN."""
    from tidemark.schemas import CATEGORIES

    names = (*CATEGORIES, "UNKNOWN")
    kind = F.coalesce(F.col("segment_input.key.category"), F.lit("UNKNOWN"))
    counts = routed.agg(*[F.count_if(kind == c).alias(c) for c in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("windows")) for c in names])).alias("x")).select("x.*")


def plan_brand_merge(t: Tables) -> DataFrame:
    """(loser_id, survivor_id, name): brands with one key; most references survive, and the best spelling names them."""
    refs = counts_of(t.events, "brand_id", "e").join(counts_of(t.mentions, "brand_id", "m"), "id", "full").join(counts_of(t.commercials, "brand_id", "c"), "id", "full")
    refs = refs.select("id", (F.coalesce("e", F.lit(0)) + F.coalesce("m", F.lit(0)) + F.coalesce("c", F.lit(0))).alias("refs"))
    rows = t.brands.withColumn("k", brand_key(F.col("canonical_name"))).where("k is not null").join(refs, "id", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    capitals = F.length("canonical_name") - F.length(F.regexp_replace("canonical_name", r"\p{Lu}", ""))
    name = F.max_by("canonical_name", F.struct(capitals.alias("u"), "refs", (-F.col("id")).alias("i")))
    known = canonicalize_brand(F.col("canonical_name"))
    alias = F.max(F.when(F.col("k").isin(*ALIASES), known))
    names = rows.groupBy("k").agg(F.coalesce(alias, name).alias("name"))
    moved = survivors(rows, ["k"], "id", [F.desc("refs"), F.col("id")])
    return moved.join(rows.select(F.col("id").alias("loser_id"), "k"), "loser_id").join(names, "k").select("loser_id", "survivor_id", "name")


def merge_brands(t: Tables, plan: DataFrame) -> Tables:
    """References go to the surviving brand; its twin ads fold and add their play counts; spellings become aliases."""
    named = plan.select(F.col("survivor_id").alias("id"), "name").distinct()
    spelled = plan.select(F.col("survivor_id").alias("id"), F.col("loser_id").alias("of")).union(plan.select(F.col("survivor_id").alias("id"), F.col("survivor_id").alias("of"))).distinct()
    spelled = spelled.join(t.brands.select(F.col("id").alias("of"), "canonical_name", "aliases"), "of").groupBy("id").agg(F.array_union(F.collect_set("canonical_name"), F.flatten(F.collect_list("aliases"))).alias("_all"))
    brands = dropped(t.brands, plan).join(named, "id", "left").join(spelled, "id", "left")
    brands = brands.withColumn("canonical_name", F.coalesce("name", "canonical_name")).withColumn("aliases", F.when(F.col("_all").isNull(), F.col("aliases")).otherwise(F.sort_array(F.array_except("_all", F.array("canonical_name")))))
    ads = repoint(t.commercials, "brand_id", plan)
    touched = plan.select(F.col("survivor_id").alias("brand_id")).distinct()
    twins = ads.join(touched, "brand_id", "left_semi")
    moved = survivors(twins, ["brand_id", "duration_bucket_seconds", "minhash_hex"], "id", [F.col("id")])
    more = ads.join(moved.select(F.col("loser_id").alias("id"), "survivor_id"), "id").groupBy(F.col("survivor_id").alias("id")).agg(F.sum("play_count").alias("_more"))
    ads = dropped(ads, moved).join(more, "id", "left").withColumn("play_count", F.col("play_count") + F.coalesce("_more", F.lit(0))).select(*t.commercials.columns)
    events = repoint(repoint(t.events, "brand_id", plan), "commercial_id", moved)
    return t.having(brands=brands.select(*t.brands.columns), commercials=ads, events=events, mentions=repoint(t.mentions, "brand_id", plan))


# ---- schema versions and the whole sequence

#: The first schema's categories.
OLD_CATEGORIES = {"MUSIC": "SONG", "DJ": "DJ", "AD": "COMMERCIAL"}


def migrate_first(t: Tables, old: DataFrame, now) -> tuple[Tables, DataFrame]:
    """Events of the first schema into these tables. The second result counts rows read, inserted and skipped."""
    table = F.create_map(*[F.lit(x) for pair in OLD_CATEGORIES.items() for x in pair])
    rows = old.withColumn("category", F.element_at(table, F.upper("category")))
    told = rows.agg(F.count(F.lit(1)).alias("read"), F.count("category").alias("inserted"), F.count_if(F.col("category").isNull()).alias("skipped"))
    rows = rows.where("category is not null").withColumn("_brand", F.when((F.col("category") == "COMMERCIAL") & (F.trim("brand_name") != ""), F.trim("brand_name")))
    names = rows.select(F.col("_brand").alias("canonical_name")).where("canonical_name is not null").distinct().join(t.brands, "canonical_name", "left_anti")
    new = next_ids(names, t.brands, ["canonical_name"]).withColumn("aliases", F.array().cast("array<string>")).withColumn("created_at", F.lit(now).cast("timestamp"))
    brands = t.brands.unionByName(new.select(*t.brands.columns))
    rows = rows.join(brands.select(F.col("id").alias("brand_id"), F.col("canonical_name").alias("_brand")), "_brand", "left")
    rows = rows.withColumn("duration", F.coalesce("duration", span_seconds(F.col("timestamp_start"), F.col("timestamp_end"))))
    rows = next_ids(rows.drop("id"), t.events, ["timestamp_start"], F.to_date("timestamp_start")).withColumn("created_at", F.lit(now).cast("timestamp"))
    kinds = dict(t.events.dtypes)
    missing = {c: F.lit(None).cast(k) for c, k in kinds.items() if c not in rows.columns}
    return t.having(brands=brands, events=t.events.unionByName(rows.withColumns(missing).select(*t.events.columns))), told


def add_runs(t: Tables, now) -> Tables:
    """From the version without runs: events without one go to a legacy run from their first start to last end."""
    bare = t.events.where("capture_run_id is null")
    span = bare.agg(F.min("timestamp_start").alias("started_utc"), F.max(F.coalesce("timestamp_end", "timestamp_start")).alias("ended_utc"), F.count(F.lit(1)).alias("n")).where("n > 0")
    run = span.select(F.lit("legacy").alias("run_id"), "started_utc", "ended_utc", F.lit("legacy").alias("pipeline_version"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("notes"), F.lit(now).cast("timestamp").alias("created_at"))
    t = open_runs(t, run)
    legacy = t.capture_runs.where("run_id = 'legacy'").select(F.col("id").alias("_run"))
    events = t.events.join(F.broadcast(legacy), F.col("capture_run_id").isNull(), "left").withColumn("capture_run_id", F.coalesce("capture_run_id", "_run"))  # one row
    return t.having(events=events.select(*t.events.columns))
