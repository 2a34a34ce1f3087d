"""Similarity joins without all pairs: an index over the rarest words of each text, bounds, then exact similarity.

Words are ordered by how few texts of their block have them, then by themselves. Two texts that are alike
must share one of their first words in this order, of their prefixes: for a Jaccard similarity of t or more
all but ceil(t * size) - 1 distinct words, for a cosine of t or more as many as leave less than t * t of the
squared length. What pairs share there bounds what they can have in common at all.
"""

from __future__ import annotations

import functools
import itertools
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import cosine, jaccard, tokens

#: What rounding may have changed in a bound.
SLACK = 1e-9


def prefixes(rows: DataFrame, block: list[str], id_: str, words: str, of_jaccard: float | None, of_cosine: float | None) -> DataFrame:
    """(block, word, id, n, at, size, rest, mass) of the prefix of each row: what alike rows share one of.

    n is how often the row has the word, at its place in the row's order, rest the squared length of what
    comes after it, size and mass the row's distinct words and squared length. Rows with a null block, a null
    id or no words are left out. A row's words are ordered in one task, as they came in one row.
    """
    there = functools.reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in [*block, id_]))
    each = rows.where(there).select(*block, F.col(id_).alias("id"), F.explode(words).alias("word"))
    each = each.groupBy(*block, "id", "word").agg(F.count(F.lit(1)).alias("n"))
    held = each.groupBy(*block, "word").agg(F.count(F.lit(1)).alias("rows"))
    own = W.partitionBy(*block, "id")
    order = own.orderBy("rows", "word")
    square = F.col("n") * F.col("n")
    each = each.join(held, [*block, "word"]).withColumn("mass", F.sum(square).over(own)).withColumn("size", F.count(F.lit(1)).over(own))
    each = each.withColumn("at", F.row_number().over(order)).withColumn("rest", F.col("mass") - F.sum(square).over(order))
    needed = F.lit(False)
    if of_jaccard is not None:
        needed |= F.col("at") <= F.col("size") - F.ceil(of_jaccard * F.col("size") - SLACK) + 1
    if of_cosine is not None:
        needed |= F.col("rest") + square >= of_cosine * of_cosine * F.col("mass") * (1 - SLACK)
    return each.where(needed).select(*block, "word", "id", "n", "at", "size", "rest", "mass")


def candidates(left: DataFrame, right: DataFrame, block: list[str], of_jaccard: float | None, of_cosine: float | None) -> DataFrame:
    """(a, b), a < b, of the rows of two prefix tables that may be alike: no pair that is alike is missing.

    A pair's shared words are added up; beyond the last of them nothing in the prefixes is shared, so the
    rest of both sides bounds what is left.
    """
    names = ["id", "n", "at", "size", "rest", "mass"]
    x = left.select(*block, "word", *[F.col(c).alias(f"{c}_a") for c in names])
    y = right.select(*block, "word", *[F.col(c).alias(f"{c}_b") for c in names])
    met = x.join(y, [*block, "word"]).where("id_a < id_b")
    first = [F.first(f"{c}_{s}").alias(f"{c}_{s}") for c in ("size", "mass") for s in "ab"]
    rest = [F.min(f"rest_{s}").alias(f"rest_{s}") for s in "ab"] + [F.max(f"at_{s}").alias(f"at_{s}") for s in "ab"]
    met = met.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("both"), F.sum(F.col("n_a") * F.col("n_b")).alias("dot"), *first, *rest)
    may = F.lit(False)
    if of_jaccard is not None:
        most = F.col("both") + F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
        may |= most >= of_jaccard * (F.col("size_a") + F.col("size_b") - most) * (1 - SLACK)
    if of_cosine is not None:
        most = F.col("dot") + F.sqrt(F.col("rest_a").cast("double") * F.col("rest_b"))
        may |= most >= of_cosine * F.sqrt(F.col("mass_a").cast("double") * F.col("mass_b")) * (1 - SLACK)
    return met.where(may).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


#: Texts of at most so many different words meet in the tasks of their words; rows of a word there that meet others in one task; pairs looked at in one step.
FEW, PART, STEP = 16, 4_096, 1 << 18


def similar_pairs(df: DataFrame, block: list[str], id_: str, text: str, least: float) -> DataFrame:
    """(a, b, similarity) of rows of one block whose texts are alike; a < b. All pairs, those of copies too.

    The similarity is the greater of token Jaccard and bag-of-words cosine, ``least`` is above 0. Rows
    with a null block or id pair with nothing, as do texts without words. Ids are taken to be unique. A block may
    hold any number of rows: work grows with the rows that share a rare word, not with pairs of a block.

    A text of few words goes to each word of its prefix as a whole, and a pair is decided at the first word that both
    have: what is shuffled and kept grows with the rows; pairs leave their task as they are found. Pairs with a longer text
    are looked for by candidates.
    """
    if least <= 0:
        raise ValueError("texts without a common word are not looked for")
    there = functools.reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in [*block, id_]))
    rows = df.where(there).select(*block, F.col(id_).alias("id"), tokens(F.col(text)).alias("words")).where(F.size("words") > 0)
    few = F.size(F.array_distinct("words")) <= FEW
    return _met_at_words(rows.where(few), block, least).unionByName(_met_by_candidates(rows, few, block, least))


def _met_by_candidates(rows: DataFrame, few: Column, block: list[str], least: float) -> DataFrame:
    """Pairs of ``rows`` with one that isn't of ``few`` words, or two."""
    long = rows.where(~few).select(*block, "id")
    beside = rows.join(long.select(*block).distinct(), block, "left_semi")
    index = prefixes(beside, block, "id", "words", least, least)
    far, near = (index.join(long.select("id"), "id", how).select(*index.columns) for how in ("left_semi", "left_anti"))
    met = candidates(far, index, block, least, least).union(candidates(near, far, block, least, least))
    told = beside.select("id", "words")
    met = met.join(told.select(F.col("id").alias("a"), F.col("words").alias("x")), "a").join(told.select(F.col("id").alias("b"), F.col("words").alias("y")), "b")
    return met.withColumn("similarity", F.greatest(jaccard(F.col("x"), F.col("y")), cosine(F.col("x"), F.col("y")))).where(F.col("similarity") >= least).select("a", "b", "similarity")


def _met_at_words(rows: DataFrame, block: list[str], least: float) -> DataFrame:
    """Pairs of ``rows``, of few words each. Rows of a frequent word are dealt out in parts, of which each two meet."""
    bag = F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("word"), F.size(F.filter("words", lambda x: x == w)).alias("n")))
    each = rows.select(*block, "id", F.inline(bag))
    held = each.groupBy(*block, "word").agg(F.count(F.lit(1)).alias("rows"))
    bags = each.join(held, [*block, "word"]).groupBy(*block, "id").agg(F.sort_array(F.collect_list(F.struct("rows", "word", "n"))).alias("bag"))
    mass = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["n"].cast("long") * x["n"])
    size = F.size("bag")
    bags = bags.select(*block, "id", "bag", F.array_join(F.col("bag.word"), " ").alias("words"), F.col("bag.n").alias("counts"), (least * least * (1 - SLACK) * mass(F.col("bag"))).alias("need"))
    at = bags.select(*block, "id", "words", "counts", "bag", "need", F.posexplode("bag").alias("at", "here"))
    by_jaccard = F.col("at") <= size - F.ceil(least * size - SLACK)
    by_cosine = mass(F.slice("bag", F.col("at") + 1, size)) >= F.col("need")
    at = at.where(by_jaccard | by_cosine).withColumn("parts", F.ceil(F.col("here.rows") / PART).cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = [*block, "word", "l", "r"]
    at = at.select(*block, F.col("here.word").alias("word"), F.least("part", "other").alias("l"), F.greatest("part", "other").alias("r"), "part", "at", "id", "words", "counts")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that tasks with few bytes and many pairs aren't put together
    dealt = at.repartition(tasks, *group).sortWithinPartitions(*group, "part")
    kind = rows.schema["id"].dataType.simpleString()
    return dealt.mapInArrow(functools.partial(_decided, group=group, least=least), f"a {kind}, b {kind}, similarity double")


def _decided(batches: Iterator[pa.RecordBatch], group: list[str], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of rows in order of their groups: within a part, or between two."""
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
        if held is None or not len(held):
            continue
        new = _changes(held, group)
        end = len(held) if batch is None else int(np.flatnonzero(new)[-1])
        if end:
            yield from _pairs_of(held.slice(0, end).combine_chunks(), new[:end], least)
            held = held.slice(end).combine_chunks()


def _changes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether a row's ``columns`` are others than those of the row before; the first row's are."""
    new = np.zeros(len(table), bool)
    new[0] = True
    for name in columns:
        column = table[name]
        one, other = column.slice(0, len(table) - 1), column.slice(1)
        changed = pc.not_equal(one, other).to_numpy().astype(bool)
        if pa.types.is_floating(column.type):
            changed &= ~(np.isnan(one.to_numpy()) & np.isnan(other.to_numpy()))
        new[1:] |= changed
    return new


def _pairs_of(rows: pa.Table, new: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of whole groups, which begin where ``new``; a pair counts in the group of the first word that both have."""
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(new))
    group = np.cumsum(new) - 1
    l, r, part, at = (rows[c].to_numpy() for c in ("l", "r", "part", "at"))
    # partners of a row: the rows after it, or those of the other part, which stand behind its own
    low = np.where(l == r, np.arange(len(new)) + 1, ends[group] - np.bincount(group, weights=part == r, minlength=len(starts)).astype(np.int64)[group])
    low = np.where((l < r) & (part == r), ends[group], low)
    sizes = ends[group] - low
    said = rows["words"].combine_chunks().dictionary_encode()
    bag = said.indices.to_numpy()
    bags = [x.split() for x in said.dictionary.to_pylist()]
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__
    width = max(map(len, bags))
    word = np.full((width, len(bags)), -1, np.int32)
    for i, x in enumerate(bags):
        word[: len(x), i] = [known[w] for w in x]
    word = word.astype(np.int16 if len(known) < 1 << 15 else np.int32)[:, bag]
    other = np.where(word < 0, word.dtype.type(-2), word)
    many = np.array([len(x) for x in bags])[bag]
    n = np.zeros((width, len(new)), np.int64)
    offset = np.cumsum(many) - many
    n[np.arange(many.sum()) - np.repeat(offset, many), np.repeat(np.arange(len(new)), many)] = rows["counts"].combine_chunks().flatten().to_numpy()
    norm, twice = np.sqrt((n.astype(np.float64) ** 2).sum(axis=0)), n.max(axis=0) > 1
    ids = rows["id"].combine_chunks()
    upto = np.cumsum(sizes)
    for cut in np.split(np.arange(len(new)), np.flatnonzero(np.diff(upto // STEP)) + 1):
        span = sizes[cut]
        if not span.sum():
            continue
        i = np.repeat(cut, span)
        j = np.arange(len(i)) + np.repeat(low[cut] - np.cumsum(span) + span, span)
        theirs, here = [x[j] for x in other], np.repeat(at[cut].astype(np.int8), span)
        both, ahead = np.zeros(len(i), np.int8), np.zeros(len(i), bool)
        hit, same = np.empty(len(i), bool), np.empty(len(i), bool)
        for k in range(width):
            mine = np.repeat(word[k][cut], span)
            np.equal(theirs[0], mine, out=hit)
            for x in theirs[1:]:
                hit |= np.equal(x, mine, out=same)
            both += hit.view(np.int8)
            ahead |= np.logical_and(hit, here > k, out=hit)
        told = np.flatnonzero(~ahead)
        i, j, both = i[told], j[told], both[told].astype(np.int64)
        dot = both.copy()
        more = np.flatnonzero(twice[i] | twice[j])
        p, q = i[more], j[more]
        for k, m in itertools.product(range(width), range(width)):
            found = np.flatnonzero(word[k][p] == other[m][q])
            dot[more[found]] += n[k][p[found]] * n[m][q[found]] - 1
        similarity = np.maximum(both / (many[i] + many[j] - both), dot / (norm[i] * norm[j]))
        alike = np.flatnonzero(similarity >= least)
        if len(alike):
            x, y = ids.take(pa.array(i[alike])), ids.take(pa.array(j[alike]))
            first = pc.less(x, y)
            out = pa.table({"a": pc.if_else(first, x, y), "b": pc.if_else(first, y, x), "similarity": similarity[alike]})
            yield from out.filter(pc.not_equal(x, y)).to_batches()


def similar_links(df: DataFrame, block: list[str], id_: str, text: str, least: float) -> DataFrame:
    """similar_pairs() by another name: no pair is folded away."""
    return similar_pairs(df, block, id_, text, least)


#: Texts of at most so many words are linked by what they share.
SHORT = 6


def _certain(x: tuple[int, ...], y: tuple[int, ...], dot: int, both: int, least: float) -> bool:
    """Whether bags with these counts are alike if what they share is at least ``both`` words and a product of ``dot``."""
    norm = math.sqrt(sum(n * n for n in x)) * math.sqrt(sum(n * n for n in y))
    return both / (len(x) + len(y) - both) >= least or dot / norm >= least


def _enough(mine: tuple[int, ...], shapes: list[tuple[int, ...]], least: float) -> list[tuple[int, ...]]:
    """Places of a bag's words that, shared with a bag of one of ``shapes``, make the two alike, but not without each of them."""
    out = []
    for k in range(1, len(mine) + 1):
        for at in itertools.combinations(range(len(mine)), k):
            own = [mine[i] for i in at]
            for theirs, other in ((u, y) for y in shapes if len(y) >= k for u in set(itertools.permutations(y, k))):
                each = [n * m for n, m in zip(own, theirs, strict=True)]
                if _certain(mine, other, sum(each), k, least) and not any(_certain(mine, other, sum(each) - e, k - 1, least) for e in each):
                    out.append(at)
                    break
    return out


def spanning_links(df: DataFrame, block: list[str], id_: str, text: str, least: float) -> DataFrame:
    """(a, b) of alike rows, as similar_pairs() has them, that have the same components, but not all pairs.

    Equal bags of words: each row and the first. Of texts of up to SHORT words, those that have a set of words in the same
    counts and the same counts in all are a kind; sets are the smallest that make any two kinds alike. If two kinds are, each row of one is
    alike to each of the other, and the first rows of both stand for it. Pairs with a longer text are looked for as in
    similar_pairs(). So where texts are short, links grow with a block's rows, not with its pairs.
    """
    if least <= 0:
        raise ValueError("texts without a common word are not looked for")
    there = functools.reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in [*block, id_]))
    rows = df.where(there).select(*block, F.col(id_).alias("id"), F.array_sort(tokens(F.col(text))).alias("bag")).where(F.size("bag") > 0)
    firsts = rows.groupBy(*block, "bag").agg(F.min("id").alias("first"))
    copies = rows.join(firsts, [*block, "bag"]).where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    firsts = firsts.select(*block, F.col("first").alias("id"), "bag")
    short = F.size("bag") <= SHORT
    of = lambda: F.transform(F.array_distinct("bag"), lambda w: F.size(F.filter("bag", lambda x: x == w)))
    counted = firsts.where(short).select(*block, "id", F.array_distinct("bag").alias("words"), of().alias("counts"))
    found = [tuple(r[0]) for r in counted.select("counts").distinct().collect()]  # few: the ways to write numbers up to SHORT as ordered sums
    shapes = list({tuple(sorted(x)) for x in found})
    places = df.sparkSession.createDataFrame([(list(x), list(at)) for x in found for at in _enough(x, shapes, least)], "counts array<int>, places array<int>")
    each = counted.join(F.broadcast(places), "counts")
    shared = F.array_join(F.transform("places", lambda i: F.get("words", i)), " ")
    each = each.select(*block, shared.alias("shared"), F.transform("places", lambda i: F.get("counts", i)).alias("own"), F.array_sort("counts").alias("shape"), "id")
    kinds = each.groupBy(*block, "shared", "own", "shape").agg(F.min("id").alias("top"))
    other = kinds.select(*block, "shared", F.col("own").alias("own_"), F.col("shape").alias("shape_"), F.col("top").alias("to"))
    mass = lambda c: F.aggregate(c, F.lit(0), lambda s, n: s + n * n)
    dot = F.aggregate(F.zip_with("own", "own_", lambda n, m: n * m), F.lit(0), lambda s, n: s + n)
    both = F.size("own")
    alike = (both / (F.size("shape") + F.size("shape_") - both) >= least) | (dot / (F.sqrt(mass("shape")) * F.sqrt(mass("shape_"))) >= least)
    near = kinds.join(other, [*block, "shared"]).where(alike)
    between = near.where("top <> to").select(*block, F.col("top").alias("a"), F.col("to").alias("b"))
    one = near.groupBy(*block, "shared", "own", "shape").agg(F.min("to").alias("to"))
    few = each.join(one, [*block, "shared", "own", "shape"]).where("id <> to").select(*block, F.col("to").alias("a"), F.col("id").alias("b"))
    few = few.unionByName(between).repartition(*block).sortWithinPartitions(*block).select("a", "b").mapInArrow(_forests, "a long, b long")

    long = firsts.where(~short)
    beside = firsts.join(long.select(*block).distinct(), block, "left_semi")
    index = prefixes(beside, block, "id", "bag", least, least)
    far = index.join(long.select("id"), "id", "left_semi").select(*index.columns)
    met = candidates(far, index, block, least, least).union(candidates(index, far, block, least, least)).distinct()
    met = met.join(beside.select(F.col("id").alias("a"), F.col("bag").alias("x")), "a").join(beside.select(F.col("id").alias("b"), F.col("bag").alias("y")), "b")
    met = met.where(F.greatest(jaccard(F.col("x"), F.col("y")), cosine(F.col("x"), F.col("y"))) >= least)
    return copies.unionByName(few).unionByName(met.select("a", "b"))


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each batch as links between each id and the smallest that it reaches in the batch."""
    for batch in batches:
        up: dict[int, int] = {}

        def top(x: int, up=up) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
        links = [(top(x), x) for x in list(up)]
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, x in links if a != x], pa.int64()), "b": pa.array([x for a, x in links if a != x], pa.int64())})


#: Rows of a block, which meets another in one task; numbers of a row there, and those of them that frequent words have to themselves.
BLOCK, WIDE, OWN = 12_288, 1_536, 1_024


def packed(words: Column) -> Column:
    """struct(bag, mass) of words joined by spaces: different words and how often each is there, compressed, and the squared length."""

    @F.pandas_udf("bag binary, mass long")
    def run(words: pd.Series) -> pd.DataFrame:
        bags, mass = [], []
        for text in words:
            bag = Counter(text.split())
            n = np.fromiter(bag.values(), "<u4", len(bag))
            bags.append(zlib.compress(n.tobytes() + " ".join(bag).encode() + len(bag).to_bytes(4, "little"), 1))
            mass.append(sum(x * x for x in bag.values()))
        return pd.DataFrame({"bag": pd.Series(bags, dtype=object), "mass": pd.Series(mass, dtype="int64")})

    return run(words)


class Bags:
    """Rows (id, bag, mass, sig) of a block in order of id, bags with numbers for words that ``known`` gives."""

    def __init__(self, rows: pa.Table, known: dict[str, int]):
        rows = rows.sort_by("id")
        self.ids, self.mass, self.sigs = rows["id"].to_numpy(), rows["mass"].to_numpy().astype(np.float64), rows["sig"].to_pylist()
        word, n = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for bag in rows["bag"]:
            flat = zlib.decompress(bag.as_py())
            many = int.from_bytes(flat[-4:], "little")
            n.append(np.frombuffer(flat, "<u4", many).astype(np.int32))
            word.append(np.fromiter(map(known.__getitem__, flat[4 * many : -4].split()), np.int32, many))
        self.at = np.cumsum([len(x) for x in n])  # the first of them is empty
        self.word, self.n = np.concatenate(word), np.concatenate(n)


class Bounds:
    """Bounds of the cosines between rows of two blocks, and their exact products.

    The frequent words of both blocks have a number each, the others share some. What is in the first alone is part of
    the product; numbers that words share only add to it.
    """

    def __init__(self, one: Bags, other: Bags):
        self.one, self.other = one, other
        words = 1 + max((int(x.word.max()) for x in (one, other) if len(x.word)), default=0)
        mass = sum(np.bincount(x.word, weights=x.n.astype(np.float64) ** 2, minlength=words) for x in (one, other))
        place = OWN + np.arange(words) % (WIDE - OWN)
        top = np.argsort(-mass, kind="stable")[:OWN]
        place[top] = np.arange(len(top))
        self.dense = [self._dense(x, place) for x in (one, other)]
        self.all = [(x.at, x.word, x.n) for x in (one, other)]
        self.rest = [(np.concatenate([[0], np.cumsum(far)])[x.at], x.word[far], x.n[far]) for x in (one, other) for far in [place[x.word] >= OWN]]
        self.row = np.zeros(words, np.int32)

    @staticmethod
    def _dense(x: Bags, place: np.ndarray) -> np.ndarray:
        out = np.empty((len(x.ids), WIDE), np.float32)
        for at in range(0, len(out), 1_024):
            end = min(at + 1_024, len(out))
            span = slice(x.at[at], x.at[end])
            row = np.repeat(np.arange(end - at), np.diff(x.at[at : end + 1]))
            out[at:end] = np.bincount(row * WIDE + place[x.word[span]], weights=x.n[span], minlength=(end - at) * WIDE).reshape(-1, WIDE)
        out /= np.sqrt(np.maximum(x.mass, 1.0))[:, None].astype(np.float32)
        return out

    def of(self, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the most that cosines of rows of one side and of the other may be, but for rounding."""
        p, q = self.dense[0][rows], self.dense[1] if len(columns) == len(self.dense[1]) else self.dense[1][columns]
        least = p[:, :OWN] @ q[:, :OWN].T
        return least, least + p[:, OWN:] @ q[:, OWN:].T

    def dots(self, i: np.ndarray, j: np.ndarray, rest: bool = False) -> np.ndarray:
        """Exact products of rows of one side and of the other, or of their ``rest``: what isn't in the least."""
        sides, out = self.rest if rest else self.all, np.zeros(len(i), np.int64)
        sizes = [np.diff(side[0])[k] for side, k in zip(sides, (i, j), strict=True)]
        # of a pair, the shorter is looked up in the longer
        for long, k, other, which in ((0, i, j, sizes[0] >= sizes[1]), (1, j, i, sizes[0] < sizes[1])):
            which = np.flatnonzero(which)
            which = which[np.argsort(k[which], kind="stable")]
            part = np.cumsum(sizes[1 - long][which]) // (1 << 19)
            for at in np.split(which, np.flatnonzero(np.diff(k[which]) | np.diff(part)) + 1) if len(which) else []:
                out[at] = self._dots(sides[long], sides[1 - long], k[at[0]], other[at])
        return out

    def _dots(self, one: tuple, other: tuple, row: int, rows: np.ndarray) -> np.ndarray:
        (at, word, n), (of, words, ns) = one, other
        mine = slice(at[row], at[row + 1])
        self.row[word[mine]] = n[mine]
        starts = of[rows]
        sizes = of[rows + 1] - starts
        ends = np.cumsum(sizes)
        flat = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
        sums = np.concatenate([[0], np.cumsum(self.row[words[flat]] * ns[flat].astype(np.int64))])
        self.row[word[mine]] = 0
        return sums[ends] - sums[ends - sizes]


def block_pairs(left: DataFrame, right: DataFrame, block: list[str], alike: Callable[[Bags, Bags], Iterator[tuple[np.ndarray, np.ndarray]]], same: bool = False) -> DataFrame:
    """(a, b) of ids of both sides (block, id, bag, mass, sig) whose places ``alike`` gives for rows of one block, a part of each side at a time.

    For texts that share many frequent words, where an index over words pairs nearly all of a block many times over; here parts of at most
    some BLOCK rows meet, each two in one task, dealt over the cluster. With ``same``, both sides are one table and pairs come once, a < b.
    """

    def dealt(df: DataFrame) -> DataFrame:
        return df.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))

    sizes = dealt(left).withColumnRenamed("n", "lefts").join(dealt(right).withColumnRenamed("n", "rights"), block)
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = [*block, "id", "bag", "mass", "sig"]
    x = left.join(sizes, block).select(*kept, part("lefts").alias("l"), "rights").withColumn("r", every("rights")).drop("rights")
    y = right.join(sizes, block).select(*[F.col(c).alias(f"of_{c}") for c in kept], part("rights").alias("of_r"), "lefts").withColumn("of_l", every("lefts")).drop("lefts")
    if same:
        x, y = x.where("l <= r"), y.where("of_l <= of_r")

    def meet(one: pa.Table, other: pa.Table) -> pa.Table:
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(one) and len(other):
            known: defaultdict = defaultdict()
            known.default_factory = known.__len__
            p, q = Bags(one, known), Bags(other.rename_columns([c.removeprefix("of_") for c in other.column_names]), known)
            for i, j in alike(p, q):
                a.append(p.ids[i])
                b.append(q.ids[j])
        a, b = np.concatenate(a), np.concatenate(b)
        if same:
            a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        return pa.table({"a": a, "b": b})

    met = x.groupBy(*block, "l", "r").cogroup(y.groupBy(*[f"of_{c}" for c in block], "of_l", "of_r")).applyInArrow(meet, "a long, b long")
    return met.distinct() if same else met
