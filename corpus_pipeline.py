"""A training corpus from ``documents``: language, near copies, repeated passages, mixture, tokens.

Counted as part of subpackage llm. Each stage takes (spark, docs, sf_dir) and works on all that the one
before it kept; all but the last return the columns of documents. An empty table gives an empty one in
every stage, and columns beyond those of documents are dropped.

A stage's result is to be written before the next stage is called: that one first deletes the tables that
earlier stages of this pipeline have left in the shared folder. Tables of other queries stay.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode_texts, tokenizer_path
from tidemark.llm.common import delete, noted, stage
from tidemark.llm.language import identify, vocabulary_path
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mix, word_count
from tidemark.llm.suffixes import remove_repeats

#: Documents whose language is less sure than this are rejected, and those without letters.
SURE = 0.4
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_LEFT = threading.local()


def _tidy(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that deletes what the stages before it have staged in this thread, and notes what it stages itself."""

    @functools.wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        folders = _LEFT.__dict__.setdefault("folders", [])
        delete(spark, folders)
        with noted(folders):
            return step(spark, docs, sf_dir)

    return run


@_tidy
def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; lang becomes the predicted one where it was null.

    Each row is judged by its own text, whatever its id. Null and empty texts and texts without a letter go.
    """
    told = identify(docs, vocabulary_path(), along=COLUMNS[1:])
    told = told.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE))
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


@_tidy
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Rows that share an id are one document: the row with the least text (null last), then the least lang,
    source and n_chars, stands for it. Rows without an id can't be named in a group and all stay, as do
    null and empty texts, which are like nothing.
    """
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    left = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    first = F.min(F.struct(F.col("text").isNull(), *COLUMNS[1:])).alias("r")
    named = left.where("doc_id is not null").groupBy("doc_id").agg(first).select("doc_id", *[F.col("r")[c].alias(c) for c in COLUMNS[1:]])
    return named.union(left.where("doc_id is null"))


@_tidy
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that start earlier in the corpus; n_chars follows the text.

    No document goes, but its text may become empty; null texts become empty ones. Rows that share an id
    are one document with the least of their texts; rows without an id stay as they are.
    """
    left = remove_repeats(docs, texts=True, along=("lang", "source"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


@_tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, 0 to 2 times.

    Rows that are equal in id, source and size are told apart by their texts; a null id or source is a
    value like another. Documents without words aren't taken.
    """
    key = ["doc_id", "source", "size"]
    taken = mix(docs).where("copies > 0").groupBy(*key).agg(F.count_if(F.col("copies") > 1).alias("twice"), F.count(F.lit(1)).alias("any"))
    taken = taken.select(*[F.col(c).alias(f"of_{c}") for c in key], "twice", "any")
    rows = docs.select(*COLUMNS).withColumn("size", word_count(F.col("text")))
    rows = rows.withColumn("nr", F.row_number().over(W.partitionBy(*key).orderBy("text")))
    same = functools.reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in key))
    copies = (F.col("nr") <= F.col("any")).cast("int") + (F.col("nr") <= F.col("twice")).cast("int")
    many = rows.join(taken, same).withColumn("copies", copies).where("copies > 0")
    return many.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


@_tidy
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row, packed, and their digests; null and empty texts have none."""
    return encode_texts(docs, tokenizer_path(), back=False).drop("decoded")


STAGES = [
    ("language", keep_identified),
    ("near_copies", keep_one_of_near_copies),
    ("repeated_passages", cut_repeated_passages),
    ("mixture", mix_sources),
    ("tokens", encode),
]

#: No SQL expresses a stage's method; a test holds each stage against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result but the last is staged, and goes when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, step in STAGES[:-1]:
        made: list[str] = []
        left = step(spark, docs, sf_dir)
        with noted(made):
            docs = stage(left, name)
        delete(spark, before)
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
