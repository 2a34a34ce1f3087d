"""Tiered routing of windows: tier results are columns, decisions a cascade, memory islands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import normalize_token, truncate
from tidemark.operators.resolve import cut, table
from tidemark.operators.sessions import cache_runs, confirm_runs, slots

KEY = "struct<category string, artist_key string, title_key string, brand_key string, song_id bigint, commercial_id bigint>"


def route_label(music: Column, speech: Column, other: Column, min_prob: float = 0.25, speech_bias: bool = True) -> Column:
    """MUSIC, SPEECH or OTHER: unsure is SPEECH, talk over music is SPEECH, else the first of the largest."""
    largest = F.greatest(music, speech, other)
    total = music + speech + other
    out = F.when(largest < min_prob, "SPEECH")
    if speech_bias:
        out = out.when((total > 0) & (music / total >= 0.35) & (speech / total >= 0.35), "SPEECH")
    return out.when(music == largest, "MUSIC").when(speech == largest, "SPEECH").otherwise("OTHER")


def segment_key(category: Column, artist: Column, title: Column, brand: Column, song_id: Column, commercial_id: Column) -> Column:
    """What makes two windows the same segment: a song id alone, else folded names."""
    named = song_id.isNull() & (category == "SONG")
    return F.struct(
        category.alias("category"),
        F.when(named, normalize_token(artist)).alias("artist_key"),
        F.when(named, normalize_token(title)).alias("title_key"),
        F.when(category != "SONG", normalize_token(brand)).alias("brand_key"),
        F.when(category == "SONG", song_id).alias("song_id"),
        F.when(category != "SONG", commercial_id).alias("commercial_id"),
    )


def plan_tiers(windows: DataFrame, by: list[str], order: list[str], override: float = 0.10, strong: float = 60.0, repeats: int = 3, recheck: int = 4) -> DataFrame:
    """Which tiers each window needs, from fp (fingerprint) and ac (acoustic) structs alone.

    Adds fp_ok (a match its neighbours confirm), music (no match, and music without much speech) and
    ``calls``: the music windows that ask the external service; the others share the answer of their answer_group.
    Only those rows go to the costly model: filter on them, call it, join back.
    """
    flat = windows.withColumn("_track", F.col("fp.track_id")).withColumn("_hit", F.coalesce(F.col("fp.status") == "match", F.lit(False))).withColumn("_score", F.col("fp.match_score"))
    slot = slots(windows, order[0])  # the same ranges serve both
    rows = confirm_runs(flat, by, order, "_track", F.col("_hit"), "_score", strong, repeats, slot).withColumn("fp_ok", F.col("accepted"))
    music = ~F.col("fp_ok") & (F.col("ac.label") == "MUSIC") & (F.col("ac.speech_prob") < override)
    rows = rows.withColumn("music", F.coalesce(music, F.lit(False)))
    rows = cache_runs(rows, by, order, ~F.col("music"), F.col("music"), recheck, slot)
    return rows.drop("_track", "_hit", "_score", "accepted", "run_position")


def share_answers(planned: DataFrame, answers: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """Gives ``sz``, the external answers of the rows with ``calls``, to all rows of their answer_group."""
    asked = planned.where("calls").join(answers, key).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("answer_group").alias("_g"), F.col("sz"))
    on = F.col("answer_group") == F.col("_g")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return planned.join(asked, on, "left").drop("_g", *[f"_{c}" for c in by])


def needs_speech(margin: float = 0.15) -> Column:
    """Windows for the speech tier: not music, or music so near to speech that the service's miss makes it worth it."""
    near = F.col("music") & (F.col("sz.status") == "no_match") & (F.col("ac.music_prob") - F.col("ac.speech_prob") <= margin) & F.lit(margin > 0)
    return F.coalesce(~F.col("fp_ok") & (~F.col("music") | near), F.lit(False))


def route(windows: DataFrame, margin: float = 0.15, excerpt: int = 512) -> DataFrame:
    """Adds stage and segment_input to planned windows with fp, ac, sz and sp (speech result or null).

    song ids are taken from fp.song_id and sz.song_id where these are there; otherwise names identify songs.
    """

    def field(s: str, name: str, kind: str) -> Column:
        return F.col(f"{s}.{name}") if name in windows.schema[s].dataType.names else F.lit(None).cast(kind)

    said = (F.col("sp.status") == "ok") & F.col("sp.category").isNotNull()
    external = F.col("music") & (F.col("sz.status") == "match")
    rescued = F.col("music") & needs_speech(margin) & said & (F.col("sp.category") != "SONG")
    stage = F.when(F.col("fp_ok"), "tier1_fingerprint").when(external, "shazam_fallback").when(rescued, "tier3_rescue").when(F.col("music"), "tier2_unknown_song").when(~F.col("music") & said, "tier3_speech").otherwise("skipped")
    none, no_id = F.lit(None).cast("string"), F.lit(None).cast("bigint")

    def made(category, artist, title, brand, song, ad, text, confidence) -> Column:
        return F.struct(segment_key(category, artist, title, brand, song, ad).alias("key"), artist.alias("artist"), title.alias("track_title"), brand.alias("brand_name"), text.alias("transcript_excerpt"), confidence.cast("double").alias("confidence"))

    song = F.lit("SONG")
    unknown = made(song, none, none, none, no_id, no_id, none, F.when(F.col("music"), F.col("ac.music_prob")).otherwise(F.col("sp.confidence")))
    spoken = made(F.col("sp.category"), none, none, F.col("sp.brand"), no_id, field("sp", "commercial_id", "bigint"), truncate(F.when(F.col("sp.transcript") != "", F.col("sp.transcript")), excerpt), F.col("sp.confidence"))
    out = (
        F.when(F.col("stage") == "tier1_fingerprint", made(song, F.col("fp.artist"), F.col("fp.title"), none, field("fp", "song_id", "bigint"), no_id, none, F.col("fp.match_score")))
        .when(F.col("stage") == "shazam_fallback", made(song, F.col("sz.artist"), F.col("sz.title"), none, field("sz", "song_id", "bigint"), no_id, none, F.col("sz.confidence")))
        .when((F.col("stage") == "tier2_unknown_song") | ((F.col("stage") == "tier3_speech") & (F.col("sp.category") == "SONG")), unknown)
        .when(F.col("stage").isin("tier3_rescue", "tier3_speech"), spoken)
    )
    return windows.withColumn("stage", stage).withColumn("segment_input", out)


def run_funnel(windows: DataFrame, by: list[str], order: list[str], key: str, ask: Callable[[DataFrame], DataFrame], speak: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """The whole cascade. ``ask`` and ``speak`` take the windows that need them and return (key, sz) and (key, sp).

    Their answers are written to the checkpoint folder before they are used: each window is asked about once. So is
    the plan, which is read three times.
    """
    planned = plan_tiers(windows, by, order, **options)
    planned = cut(planned) if "void" in planned.schema.simpleString() else table(planned)
    answered = share_answers(planned, cut(ask(planned.where("calls")).select(key, "sz")), by, order, key)
    spoken = cut(speak(answered.where(needs_speech())).select(key, "sp"))
    return route(answered.join(spoken, key, "left"))


#: Classes of music and speech by the beginnings of their names.
MUSIC_CLASSES = (
    "Music", "Singing", "Yodeling", "Choir", "Rapping", "Beatboxing", "Drum", "Drum kit", "Drum machine", "Snare drum", "Bass drum", "Cymbal", "Hi-hat",
    "Guitar", "Bass guitar", "Electric guitar", "Acoustic guitar", "Banjo", "Mandolin", "Ukulele", "Violin, fiddle", "Cello", "Double bass", "Harp", "Piano",
    "Keyboard (musical)", "Organ", "Synthesizer", "Trumpet", "Trombone", "Saxophone", "Flute", "Clarinet", "Harmonica", "Accordion", "Bagpipes",
    "Steel guitar, slide guitar", "Ambient music", "Background music", "Pop music", "Rock music", "Heavy metal", "Hip hop music", "Country", "Soul music",
    "Blues", "Jazz", "Funk", "Reggae", "Folk music", "Electronic music", "Dance music", "Punk rock", "House music", "Techno", "Dubstep", "Trance music",
)
SPEECH_CLASSES = (
    "Speech", "Male speech, man speaking", "Female speech, woman speaking", "Child speech, kid speaking", "Conversation", "Narration, monologue",
    "Babbling", "Whispering", "Shout", "Yell",
)


def class_group(name: Column) -> Column:
    """music, speech or other, by the beginning of a class's name."""

    def starts(prefixes: tuple[str, ...]) -> Column:
        return F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(F.trim(name), p))

    return F.when(starts(MUSIC_CLASSES), "music").when(starts(SPEECH_CLASSES), "speech").otherwise("other")
