"""Mixing sources to target weights by entropy balancing: Newton steps on the convex dual, DataFrames only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, stage, unstage

#: Exact sums: doubles are rounded to so many decimals before they are added, so order changes nothing.
_EXACT = "decimal(38,9)"
#: Share of a source's words by which a solved rate may miss its target; rounds after which bisection has halved enough.
TOLERANCE, ROUNDS = 1e-7, 60
#: How often one document of a source may change by a copy to close what rounding left open.
CLOSING = 4


def _sum(c: Column) -> Column:
    return F.sum(c.cast(_EXACT)).cast("double")


def word_count(text: Column) -> Column:
    """The number of runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) -> with target: ``share`` of all sizes by repeating weights, none above ``most`` times its size.

    The excess of sources that would go above goes to the others by weight until none is above: all
    others end at one level times their weight. Sources are ordered by code point, null last.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("double"))
    ranked = ranked.withColumn("limit", F.lit(most) * F.col("source_size")).withColumn("full_at", F.col("limit") / F.col("w"))
    up = W.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    total = F.sum("source_size").over(everything) * share
    # were this source and those before it the full ones at their limit, what level would the rest have?
    rest = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(up), F.lit(0.0))
    level = (total - F.coalesce(F.sum("limit").over(up), F.lit(0.0))) / rest
    leveled = ranked.withColumn("level", level).withColumn("open", F.col("level") < F.col("full_at"))
    final = leveled.withColumn("final", F.min(F.when(F.col("open"), F.struct("full_at", "level"))).over(everything)["level"])
    return final.select("source", "source_size", F.when(F.col("final") * F.col("w") < F.col("limit"), F.col("final") * F.col("w")).otherwise(F.col("limit")).alias("target"))


def balance(histogram: DataFrame, wanted: DataFrame, most: float) -> DataFrame:
    """(source, lam, mean): the dual solution of each source; a document's rate is min(most, exp(lam * size / mean)).

    These rates are nearest to 1 in relative entropy among rates up to ``most`` with the wanted words of
    their source. The dual is convex with one number for each source; a Newton step is one aggregation
    over the (source, size, n) histogram, kept inside a bracket that shrinks, and halved into it where a
    step would leave it. Sources whose target is their limit have infinite lam; no size, no rate.
    """
    mean = F.sum(F.col("size") * F.col("n")) / F.sum("n")
    means = histogram.where("size > 0").groupBy("source").agg(mean.alias("mean"))
    inner = wanted.join(means, wanted["source"].eqNullSafe(means["source"])).select(wanted["source"], "target", "source_size", "mean")
    full = F.col("target") >= F.lit(most) * F.col("source_size") * (1 - 1e-12)
    state = inner.select("source", "target", "source_size", "mean", F.when(full, F.lit(float("inf"))).when(F.col("target") <= 0, F.lit(float("-inf"))).otherwise(F.lit(0.0)).alias("lam"), F.lit(-64.0).alias("low"), F.lit(64.0).alias("high"))
    state = stage(state.withColumn("done", F.abs("lam") == float("inf")), "dual")
    u = F.col("lam") * F.col("size") / F.col("mean")
    free = u < F.log(F.lit(most))
    rate = F.when(free, F.exp(F.least(u, F.lit(64.0)))).otherwise(F.lit(most))
    words = F.col("n") * F.col("size")
    for _ in range(ROUNDS):
        if state.where("not done").isEmpty():
            break
        open_ = state.where("not done")
        at = histogram.withColumnRenamed("source", "of").join(open_, F.col("of").eqNullSafe(open_["source"]))
        sums = at.groupBy("source").agg(_sum(words * rate).alias("taken"), _sum(F.when(free, words * rate * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        now = open_.join(sums.withColumnRenamed("source", "of"), F.col("of").eqNullSafe(open_["source"]))
        gap = F.col("taken") - F.col("target")
        now = now.withColumn("low", F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(gap >= 0, F.col("lam")).otherwise(F.col("high")))
        step = F.col("lam") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high"))
        done = F.abs(gap) <= TOLERANCE * F.col("source_size")
        after = now.select("source", "target", "source_size", "mean", F.when(done, F.col("lam")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2).alias("lam"), "low", "high", (done | (F.col("high") - F.col("low") < 1e-12)).alias("done"))
        before, state = state, stage(state.where("done").unionByName(after), "dual")
        unstage(before)
    return state.select("source", "lam", "mean")


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row of ``docs``.

    size is the number of runs without white space (null: 0). Entropy balancing gives each document a rate
    of up to ``most``, exponentially tilted by its size, such that a source's expected words are its
    target. Rates become whole copies: all have the whole part of their rate, and the rest is filled up
    by documents in order of a seeded hash over the fraction, up to the document that brings the source
    nearest to its target; up to ``CLOSING`` times, one document more or one less then closes the gap as well
    as it can. taken is copies * size; a source misses its target by half a document at most, and mostly by
    a few words.

    A null source is a source of its own, the last. Empty texts have size 0 and no copies. Rows that
    repeat an id are separate documents with one hash. An empty table gives an empty one; reruns agree.
    Running sums go over hash bins of a few hundred documents and then within a bin, so that a source with a third of
    all rows is spread over many tasks.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    rows = stage(rows, "sizes")
    histogram = stage(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    wanted = stage(targets(sizes.select("source", "source_size"), weights, share, float(most)), "targets")
    dual = balance(histogram, wanted, float(most))
    per = wanted.join(dual.withColumnRenamed("source", "of"), F.col("of").eqNullSafe(wanted["source"]), "left").drop("of")
    per = per.join(sizes.select(F.col("source").alias("of"), "docs"), F.col("of").eqNullSafe(per["source"])).drop("of")
    per = stage(per, "rates")
    tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(64.0)))
    rate = F.when((F.col("size") == 0) | F.col("mean").isNull(), F.lit(0.0)).when(F.col("lam") == float("inf"), F.lit(float(most))).when(F.col("lam") == float("-inf"), F.lit(0.0)).otherwise(F.least(F.lit(float(most)), tilt))
    each = rows.join(per.withColumnRenamed("source", "of"), F.col("of").eqNullSafe(rows["source"])).drop("of").withColumn("rate", F.round(rate, 9))
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))
    each = each.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.floor("rate"))
    each = each.withColumn("rank", F.when(F.col("part") > 0, u / F.col("part")))
    # bins in order of rank: about 500 documents each, by the rank's place between 0 and infinity
    bins = F.ceil(F.col("docs") / 500.0)
    each = each.withColumn("bin", F.when(F.col("part") > 0, F.floor(bins * F.col("rank") / (F.col("rank") + 1))))
    base = each.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"))
    per_bin = each.where("part > 0").groupBy("source", "bin").agg(F.sum("size").alias("in_bin"))
    ahead = F.coalesce(F.sum("in_bin").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = per_bin.withColumn("ahead", ahead).join(base.withColumnRenamed("source", "of"), F.col("of").eqNullSafe(F.col("source"))).select("of", F.col("bin").alias("of_bin"), "ahead", "sure")
    tried = each.where("part > 0").join(offsets, F.col("of").eqNullSafe(F.col("source")) & (F.col("bin") == F.col("of_bin")))
    inside = W.partitionBy("source", "bin").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("sure") + F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    tried = tried.withColumn("extra", (before + F.col("size") / 2.0 <= F.col("target")).cast("int"))
    columns = ["row", "doc_id", "source", "size", "source_size", "target", "whole", "extra"]
    plain = each.where("part = 0").withColumn("extra", F.lit(0))
    both = tried.select(*columns[1:]).unionByName(plain.select(*columns[1:]))
    out = stage(both.select(F.monotonically_increasing_id().alias("row"), *columns[1:]), "rounded")
    # then, a few times, one row of each source changes by a copy, where that brings the source nearer;
    # rows are numbered as written, as several may be alike in all else
    copies = (F.col("whole") + F.col("extra")).cast("long")
    for _ in range(CLOSING):
        short = out.groupBy("source").agg((F.max("target") - F.sum(copies * F.col("size"))).alias("short"))
        able = F.when(F.col("short") > 0, copies < most).otherwise(F.col("extra") > 0)
        off = F.abs(F.abs("short") - F.col("size"))
        near = out.join(short.withColumnRenamed("source", "of"), F.col("of").eqNullSafe(out["source"]))
        near = near.where((F.col("size") > 0) & able & (off < F.abs("short")))
        best = F.min(F.struct(off.alias("off"), "doc_id", "size", "row")).alias("best")
        near = near.groupBy("of").agg(best, F.first(F.signum("short")).cast("int").alias("by"))
        change = stage(near.select(F.col("best.row").alias("of_row"), "by"), "change")
        if change.isEmpty():
            break
        out = out.join(change, F.col("of_row") == F.col("row"), "left").withColumn("extra", F.col("extra") + F.coalesce("by", F.lit(0))).select(*columns)
    return out.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source", "copies")
