"""The speech tier: loudness gate, transcription, quality gate, classification, canonical brand, last gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.brands import canonicalize_brand
from tidemark.functions.text import spoken_gate, transcript_gate
from tidemark.operators.resolve import cut
from tidemark.sources.readers import parse_answers, rms

#: Windows quieter than this are not transcribed.
LEAST_RMS = 750.0


def speech_tier(windows: DataFrame, key: str, transcribe: Callable[[DataFrame], DataFrame], classify: Callable[[DataFrame], DataFrame], pcm: str = "pcm", least_rms: float = LEAST_RMS) -> DataFrame:
    """(key, sp) of windows with 16-bit samples: sp has status, category, brand, transcript, confidence, message.

    ``transcribe`` takes (key, pcm) of the windows that are loud enough and returns (key, transcript),
    null where it failed; ``classify`` takes (key, transcript) of the usable ones and returns (key,
    answer_json). Neither sees other rows. status is skipped, error or ok; a transcript that a gate
    refuses is skipped, an answer that breaks the contract an error. What the models return is written to
    the checkpoint folder before it is used, so that no window is heard or judged twice.
    """
    loud = windows.select(key, pcm, rms(F.col(pcm)).alias("_rms"))
    heard = cut(transcribe(loud.where(F.col("_rms") >= least_rms).select(key, pcm)).select(key, "transcript"))
    rows = loud.select(key, "_rms").join(heard, key, "left").withColumn("_why", F.when(F.col("transcript").isNotNull(), transcript_gate(F.col("transcript"))))
    said = cut(classify(rows.where("transcript is not null and _why is null").select(key, "transcript")).select(key, "answer_json"))
    rows = rows.join(parse_answers(said, "answer_json").select(key, "answer", "valid"), key, "left")
    late = spoken_gate(F.col("transcript"), F.col("answer.category"))
    quiet = F.col("_rms") < least_rms
    status = F.when(quiet | F.col("_why").isNotNull(), "skipped").when(F.col("transcript").isNull() | ~F.coalesce("valid", F.lit(False)), "error").when(late.isNotNull(), "skipped").otherwise("ok")
    message = F.when(quiet, F.format_string("rms %.1f is below %.1f", F.col("_rms"), F.lit(least_rms))).when(F.col("transcript").isNull(), "not transcribed").when(F.col("_why").isNotNull(), F.col("_why")).when(~F.coalesce("valid", F.lit(False)), "invalid answer").otherwise(late)
    ok = status == "ok"
    sp = F.struct(
        status.alias("status"), F.when(ok, F.col("answer.category")).alias("category"), F.when(ok, canonicalize_brand(F.col("answer.brand"))).alias("brand"),
        F.col("transcript"), F.when(ok, F.col("answer.confidence")).alias("confidence"), message.alias("message"),
    )
    return rows.select(key, sp.alias("sp"))
