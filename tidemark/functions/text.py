"""Identity keys and similarities as column expressions; all but text_similarities stays in the JVM."""

from __future__ import annotations

import functools
import math
import sys
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Apostrophes that count as '.
APOSTROPHES = "‘’ʼ‛"
#: Patterns of title and artist qualifiers.
TITLE_PUNCTUATION = r"[()\[\]{}.,]+"
FEATURE_TAIL = r"(?iU)\s+(?:feat|ft|featuring)\.?\s+.+$"
REMIX_TAIL = r"(?iU)\s+[A-Za-z0-9&.' -]*\bremix\b\s*$"
UNDERSCORE_TAIL = r"(?U)\s+_\s+.+$"
REMIX_ARTIST_TAIL = r"(?iU)\s+(?:[&_+]|\band\b)\s+.+$"
BRACKETED_FEATURE = r"(?iU)\s*(?:\(|\[)\s*(?:feat\.?|featuring|ft\.?|with)\b.*?(?:\)|\])\s*$"
REFERENCE_TAIL = r"(?iU)\s*\(\s*(?:alt(?:ernate|ernative)?|ref(?:erence)?|source|src|v)\s*\d*\s*\)\s*$"
AUDIO_SUFFIX = r"(?i)\.(?:mp3|wav|flac|ogg|m4a|opus|webm)$"


@functools.lru_cache
def _folds() -> dict[str, str]:
    """Characters whose case fold is not their lower case, by rule from the Unicode database."""
    found = {chr(c): chr(c).casefold() for c in range(0x80, sys.maxunicode + 1) if chr(c).casefold() != chr(c).lower()}
    return found | {"Σ": "σ"}  # lower() of a capital sigma depends on what follows


def table(pairs: dict[str, str]) -> Column:
    """A constant map, made from one literal, as many would each cost a call to the JVM."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in pairs.items())), F.lit("\x02"), F.lit("\x01"))


def fold(c: Column) -> Column:
    """Full case folding: lower() alone, but character by character where the two differ."""
    folds = _folds()
    special = "[" + "".join(f"\\x{{{ord(k):x}}}" for k in folds) + "]"
    each = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(table(folds), x), F.lower(x))), "")
    # all of these have more bytes than characters, which is cheaper to ask than the class
    return F.when((F.octet_length(c) != F.char_length(c)) & c.rlike(special), each).otherwise(F.lower(c))


def collapse(c: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def once_each(df: DataFrame, column: str, name: str, rule) -> DataFrame:
    """``df`` with ``name`` = rule(column), which is computed once for each different value and joined; null gives null."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_value")).distinct().withColumn(name, rule(F.col("_value")))
    return df.join(values, F.col(column) == F.col("_value"), "left").drop("_value")


def normalize_token(c: Column) -> Column:
    """Folded and collapsed, without `'’. at the ends; null if nothing is left."""
    return blank_to_null(F.regexp_replace(fold(collapse(c)), "^[`'’.]+|[`'’.]+$", ""))


def _plain_apostrophes(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), APOSTROPHES, "'" * len(APOSTROPHES))


def display_key(c: Column) -> Column:
    """Folded and collapsed, without apostrophes and underscores; empty for null."""
    return fold(collapse(F.translate(_plain_apostrophes(c), "'_", "")))


def _bare_title(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.regexp_replace(c, r"(?U)\s+_", " "), "_", ""), TITLE_PUNCTUATION, " ")


def song_title_key(c: Column) -> Column:
    """display_key without wrapping punctuation, featured artists and remix tails."""
    bare = F.regexp_replace(F.regexp_replace(_bare_title(_plain_apostrophes(c)), FEATURE_TAIL, ""), REMIX_TAIL, "")
    return fold(collapse(F.replace(bare, F.lit("'"), F.lit(""))))


def title_is_remix(c: Column) -> Column:
    return _bare_title(F.coalesce(c, F.lit(""))).rlike(REMIX_TAIL)


def song_artist_key(artist: Column, title: Column) -> Column:
    """display_key without collaborators after an underscore, and for remixes after &, _, + or and."""
    first = F.regexp_replace(F.coalesce(artist, F.lit("")), UNDERSCORE_TAIL, "")
    return display_key(F.when(title_is_remix(title), F.regexp_replace(first, REMIX_ARTIST_TAIL, "")).otherwise(first))


def tracklist_key(c: Column) -> Column:
    """What tracklist containment compares: display_key without bracketed guests."""
    return normalize_token(display_key(F.regexp_replace(c, BRACKETED_FEATURE, "")))


#: Display names that replace what detectors report.
ARTIST_ALIASES = {"linkin park": "Linkin Park"}


def display_value(c: Column, aliases: dict[str, str] | None = None) -> Column:
    clean = F.coalesce(blank_to_null(collapse(c)), c)
    if not aliases:
        return clean
    return F.coalesce(F.element_at(table(aliases), display_key(clean)), clean)


def prefer_display(existing: Column, incoming: Column, aliases: dict[str, str] | None = None, key=display_key) -> Column:
    """The less noisy of two spellings of one identity; the existing one where nothing speaks for the other."""
    a, b = display_value(existing, aliases), display_value(incoming, aliases)
    artifact, small = r"[A-Za-z0-9]_[A-Za-z0-9]", r"\p{Ll}"

    def quality(c: Column) -> Column:
        return F.when(c.contains("'"), 2).when(c.rlike(f"[{APOSTROPHES}]"), 1).otherwise(0)

    out = F.when(a.isNull() | (a == ""), b).when(b.isNull() | (b == "") | (a == b) | (key(a) != key(b)), a)
    if aliases:
        out = out.when(display_key(a).isin(*aliases), b)
    out = out.when(a.rlike(artifact) & ~b.rlike(artifact), b).when(b.rlike(artifact) & ~a.rlike(artifact), a)
    out = out.when(quality(b) > quality(a), b).when(quality(a) > quality(b), a)
    return out.when(~a.rlike(small) & b.rlike(small), b).otherwise(a)


def split_track_id(track: Column) -> Column:
    """struct(artist, title) of a reference file's name."""
    base = F.regexp_replace(F.regexp_replace(F.replace(track, F.lit("\\"), F.lit("/")), "^.*/", ""), AUDIO_SUFFIX, "")
    sep = F.when(base.contains(" - "), " - ").when(base.contains("_-_"), "_-_")
    at = F.locate(" - ", base)
    at = F.when(at > 0, at).otherwise(F.locate("_-_", base))
    artist = F.when(sep.isNotNull(), F.substring(base, F.lit(1), at - 1))
    rest = F.when(sep.isNotNull(), F.substring(base, at + 3, F.length(base))).otherwise(base)
    return F.struct(blank_to_null(F.trim(artist)).alias("artist"), blank_to_null(F.trim(F.regexp_replace(rest, REFERENCE_TAIL, ""))).alias("title"))


def tokens(c: Column) -> Column:
    """Runs of ASCII letters, digits and apostrophes, folded."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([A-Za-z0-9']+)"), 1), F.lower)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body, or a lambda in it, uses it."""
    return F.transform(F.array(value), body)[0]


def cosine(a: Column, b: Column) -> Column:
    """Of two token arrays as bags of words; 0 if either is empty.

    The words of both, marked with their side, are sorted once; equal words then stand in runs, those of
    one side before those of the other, so one pass over the runs has the three sums.
    """
    marked = F.array_sort(F.concat(F.transform(a, lambda w: F.concat(w, F.lit("\x01"))), F.transform(b, lambda w: F.concat(w, F.lit("\x02")))))

    def run(m: Column, ends: Column) -> Column:
        start = F.struct(*[F.lit(0.0).alias(n) for n in ("xy", "xx", "yy")], F.lit("").alias("word"), F.lit(0).alias("at"), F.lit(0.0).alias("n"))

        def step(s: Column, end: Column) -> Column:
            word, n = m[end - 1], (end - s["at"]).cast("double")
            stem, first = F.substring(word, F.lit(1), F.length(word) - 1), F.endswith(word, F.lit("\x01"))
            both = ~first & (s["word"] == stem)
            return F.struct(
                (s["xy"] + F.when(both, s["n"] * n).otherwise(0.0)).alias("xy"), (s["xx"] + F.when(first, n * n).otherwise(0.0)).alias("xx"), (s["yy"] + F.when(first, 0.0).otherwise(n * n)).alias("yy"),
                F.when(first, stem).otherwise("").alias("word"), end.alias("at"), n.alias("n"),
            )

        return F.aggregate(ends, start, step, lambda s: s["xy"] / (F.sqrt(s["xx"]) * F.sqrt(s["yy"])))

    def ends(m: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size(m)), lambda i: (i == F.size(m)) | (m[i - 1] != F.get(m, i)))

    found = let(marked, lambda m: let(ends(m), lambda e: run(m, e)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(found)


def text_similarity(a: Column, b: Column) -> Column:
    """The greater of token Jaccard and bag-of-words cosine of two texts."""
    x, y = tokens(a), tokens(b)
    return F.greatest(jaccard(x, y), cosine(x, y))


#: Bytes of words to lower case, all others to spaces.
_WORD_BYTES = bytes(c if chr(c) in "0123456789'abcdefghijklmnopqrstuvwxyz" else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def text_similarities(a: Column, b: Column) -> Column:
    """struct(jaccard, cosine) of two texts: what ``jaccard`` and ``cosine`` give for their ``tokens``, for long texts.

    A bag of words is counted in one pass over the bytes, where columns would go through arrays word by word.
    """

    @F.pandas_udf("jaccard double, cosine double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(a), 2))
        for i, pair in enumerate(zip(a, b, strict=True)):
            x, y = (Counter((t or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()) for t in pair)
            if x and y:
                if len(y) < len(x):
                    x, y = y, x
                met = [(n, y[w]) for w, n in x.items() if w in y]
                norm = math.sqrt(sum(n * n for n in x.values())) * math.sqrt(sum(n * n for n in y.values()))
                out[i] = len(met) / (len(x) + len(y) - len(met)), sum(m * n for m, n in met) / norm
        return pd.DataFrame(out, columns=["jaccard", "cosine"])

    return run(a, b)


def shingles(words: Column, n: int = 3) -> Column:
    """Distinct runs of ``n`` tokens; the tokens themselves if there are fewer."""

    def runs(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
        each = F.transform(at, lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))
        return F.array_distinct(F.when(F.size(w) >= n, each).otherwise(w))

    return let(words, runs)


def bucket_duration(seconds: Column, bucket: int = 5) -> Column:
    """Nearest multiple, halves to the even one."""
    return (F.bround(seconds / bucket) * bucket).cast("int")


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def excerpt(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def filename_stem(c: Column) -> Column:
    """Characters that file names don't take as _, spaces collapsed, dots and spaces off the ends."""
    return F.regexp_replace(collapse(F.regexp_replace(c, r"[^\p{L}\p{N} ._()\-&,]", "_")), r"^[ .]+|[ .]+$", "")


def label_key(c: Column) -> Column:
    """Lower case, underscores as spaces, collapsed."""
    return collapse(F.translate(F.lower(c), "_", " "))


def cache_key(c: Column) -> Column:
    return collapse(F.lower(c))


def query_escape(c: Column) -> Column:
    """A backslash before characters that Lucene's query syntax reserves."""
    return F.regexp_replace(c, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")


def lookup_title(c: Column) -> Column:
    """A title as a catalogue of releases has it: without featured artists; empty for null."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), FEATURE_TAIL, ""))


def release_query(artist: Column, title: Column) -> Column:
    """The phrase query for a recording in a catalogue of releases; null where artist or title is missing."""

    def phrase(c: Column) -> Column:
        return F.regexp_replace(c, r'(["\\])', r"\\$1")

    a, t = F.trim(F.coalesce(artist, F.lit(""))), lookup_title(title)
    return F.when((a != "") & (t != ""), F.concat(F.lit('artist:"'), phrase(a), F.lit('" AND recording:"'), phrase(t), F.lit('"')))


def json_list(c: Column) -> Column:
    """A JSON list of strings; empty if it is none."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


#: Endings that speech recognition makes up on silence and music.
HALLUCINATIONS = (
    "thanks for watching",
    "thank you for watching",
    "like and subscribe",
    "subscribe to our channel",
    "see you next time",
    "see you in the next video",
    "see you in the next one",
    "see you next video",
    "see you in the next",
    "see you next",
)
MIN_WORDS = 4


def transcript_gate(c: Column) -> Column:
    """Why a transcript is unusable (empty, hallucination, short), or null if it is usable."""
    flat = collapse(F.lower(F.coalesce(c, F.lit(""))))
    made_up = functools.reduce(lambda x, y: x | y, (flat.contains(p) for p in HALLUCINATIONS))
    return F.when(flat == "", "empty").when(made_up, "hallucination").when(F.size(F.split(flat, " ")) < MIN_WORDS, "short")


def spoken_gate(c: Column, category: Column) -> Column:
    """The same for transcripts already classified: only DJ and STATION can fail."""
    return F.when(category.isin("DJ", "STATION"), transcript_gate(c))
