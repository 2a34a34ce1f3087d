"""Language identification: unigram piece models, scored by the sum over all segmentations of a text's words."""

from __future__ import annotations

import base64
import codecs
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stage, tidied, unstage
from tidemark.llm.text import category_class

#: The bounded sample that a model is fitted on: labelled documents and most frequent words of each language.
SAMPLE_DOCS, SAMPLE_WORDS = 400, 20_000
#: Words, and bytes of words, whose scores a task remembers before it starts afresh, and scores that it remembers or sums up at once.
CACHED_WORDS, CACHED_BYTES, CACHED_SCORES = 400_000, 16_000_000, 8_000_000
#: Languages whose piece probabilities a task holds as a whole table; it takes the others in turn.
TOGETHER = 64
#: Places after which the sums over segmentations are brought back to 1, so that long words don't underflow.
RESCALE = 8
#: Numbers in the largest array of sums; words are scored in blocks of that.
CELLS = 2_000_000
_BASE = 0x9E3779B97F4A7C15


class Words:
    """Letters and the marks on them, in runs, lower-cased; patterns for ASCII, Latin-1 and any text, of which the first are faster."""

    def __init__(self, classes: list[str]):
        self.find = [re.compile(c).findall for c in classes]

    def __call__(self, text: str) -> list[str]:
        text = text.lower()
        if text.isascii():
            return self.find[0](text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find[2](text)
        return self.find[1](text)


def bytes_of(word: str) -> bytes:
    """A whole word with a space before it, in UTF-8."""
    return b" " + word.encode("utf-8", "replace")


def occurs(piece: bytes) -> bool:
    """Whether a piece can stand in a word: letters and marks as lower() leaves them, after a space or not, cut at any byte."""
    if len(piece) == 1:
        return True
    rest = piece[1:] if piece[:1] == b" " else piece
    cut = 0 if piece[:1] == b" " else next((i for i, b in enumerate(piece[:3]) if not 0x80 <= b < 0xC0), 3)
    rest = rest[cut:]
    try:
        letters = codecs.getincrementaldecoder("utf-8")().decode(rest)
    except UnicodeDecodeError:
        return False
    return all(unicodedata.category(c)[0] in "LM" and c.lower() == c for c in letters)


class Lattice:
    """All places of vocabulary pieces in words; pieces that no word can hold aren't looked for."""

    def __init__(self, pieces: list[bytes]):
        self.none = len(pieces)
        self.table = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)
        wanted = np.array([i for i, p in enumerate(pieces) if occurs(p)], np.int32)
        self.lengths = sorted({len(pieces[i]) for i in wanted})
        self.power = np.multiply.accumulate(np.array([1] + [_BASE] * self.lengths[-1], np.uint64))
        self.keys = np.zeros(len(pieces) + 1, np.uint64)
        for n in self.lengths:
            same = np.array([i for i in wanted if len(pieces[i]) == n])
            self.keys[same] = self._prefixes(np.frombuffer(b"".join(pieces[i] for i in same), np.uint8).reshape(-1, n))[:, -1]
        if len(np.unique(self.keys[wanted])) < len(wanted) or not self.keys[wanted].all():
            raise ValueError("two pieces have one hash")
        # slots by a few bits of the hash; pieces that find theirs taken go to the next table
        self.levels, left = [], wanted
        while len(left):
            bits = 18 if not self.levels else 16
            slot = self._slots(self.keys[left], len(self.levels), bits)
            table = np.full(1 << bits, self.none, np.int32)
            table[slot] = left
            self.levels.append((bits, table))
            left = left[table[slot] != left]

    @staticmethod
    def _slots(h: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (h * np.uint64(0xD6E8FEB86659FD93 + 2 * level)) >> np.uint64(64 - bits)

    def _prefixes(self, rows: np.ndarray) -> np.ndarray:
        """For each row the hashes of its prefixes, that of the empty one first."""
        out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
        for j in range(rows.shape[1]):
            out[:, j + 1] = out[:, j] * np.uint64(_BASE) + self.table[rows[:, j]]
        return out

    def pieces_of(self, h: np.ndarray) -> np.ndarray:
        """The piece with each hash, or as many as there are pieces for none."""
        out = None
        for level, (bits, table) in enumerate(self.levels):
            piece = table[self._slots(h, level, bits)]
            found = np.where(self.keys[piece] == h, piece, np.int32(self.none))
            out = found if out is None else np.minimum(out, found)
        return out

    def edges(self, rows: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
        """For each end the (begin, piece of each row there) at which some row has a piece; none: as many as there are pieces."""
        h, size = self._prefixes(rows), rows.shape[1]
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(size + 1)]
        for n in self.lengths:
            if n > size:
                break
            found = self.pieces_of(h[:, n:] - h[:, :-n] * self.power[n])
            for begin in np.flatnonzero((found < self.none).any(axis=0)):
                out[begin + n].append((int(begin), found[:, begin]))
        return out


def padded(size: int) -> int:
    """The common length of the words that are handled together: their own if short, else rounded up by an eighth or so."""
    step = 1 if size <= 16 else 4 if size <= 64 else 1 << (size.bit_length() - 3)
    return -(-size // step) * step


def blocks_of(words: list[bytes], width: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(places in ``words``, their bytes as rows filled up with 0, their lengths), in blocks of a bounded size."""
    by_size: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        by_size[padded(len(w))].append(i)
    for size, found in by_size.items():
        step = max(1, CELLS // ((size + 1) * max(width, 4)))
        for at in range(0, len(found), step):
            some = found[at : at + step]
            rows = np.frombuffer(b"".join(words[i].ljust(size, b"\0") for i in some), np.uint8).reshape(-1, size)
            yield some, rows, np.array([len(words[i]) for i in some])


def _reach(edges: list) -> int:
    return max((end - begin for end, found in enumerate(edges) for begin, _ in found), default=1)


def forward(rows: np.ndarray, edges: list, weights: np.ndarray) -> np.ndarray:
    """[place, row, language]: log of the summed probability of all segmentations up to each place.

    Sums are of products, not of logs; every few places the latest ones are divided by the last, which
    ``scale`` remembers, so that no word is too long.
    """
    n = rows.shape[1]
    alpha = np.zeros((n + 1, len(rows), weights.shape[1]))
    scale = np.zeros_like(alpha)
    alpha[0], reach = 1, _reach(edges)
    for end in range(1, n + 1):
        scale[end] = scale[end - 1]
        for begin, piece in edges[end]:
            alpha[end] += alpha[begin] * weights[piece]
        if end % RESCALE == 0:
            last = alpha[end].copy()
            recent = slice(max(0, end - reach), end + 1)
            alpha[recent] /= last
            scale[recent] += np.log(last)
    return np.log(alpha) + scale


def backward(rows: np.ndarray, lens: np.ndarray, edges: list, weights: np.ndarray) -> np.ndarray:
    """[place, row, language]: log of the summed probability of all segmentations from each place to a row's end."""
    n, reach = rows.shape[1], _reach(edges)
    after: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n + 1)]
    for end, found in enumerate(edges):
        for begin, piece in found:
            after[begin].append((end, piece))
    beta = np.zeros((n + 1, len(rows), weights.shape[1]))
    scale = np.zeros_like(beta)
    beta[n, lens == n] = 1
    for begin in range(n - 1, -1, -1):
        scale[begin] = scale[begin + 1]
        beta[begin, lens == begin] = 1
        for end, piece in after[begin]:
            beta[begin] += beta[end] * weights[piece]
        if begin % RESCALE == 0:
            last = np.where(beta[begin] > 0, beta[begin], 1)
            recent = slice(begin, min(n, begin + reach) + 1)
            beta[recent] /= last
            scale[recent] += np.log(last)
    with np.errstate(divide="ignore"):
        return np.log(beta) + scale


@dataclass
class Sparse:
    """[piece, language] probabilities as estimated: the pieces seen in each language, and what all pieces are shrunk towards."""

    #: For each language its seen pieces and their expected numbers.
    seen: list[tuple[np.ndarray, np.ndarray]]
    back: np.ndarray
    smoothing: float
    last: tuple = field(default=(None, None), repr=False)

    def __getitem__(self, languages: slice) -> np.ndarray:
        """The table of some languages, with a last row of zeros for what is no piece; the latest one is kept."""
        if self.last[0] != (languages.start, languages.stop):
            self.last = (None, None)
            some = self.seen[languages]
            table = np.zeros((len(self.back) + 1, len(some)))
            for g, found in enumerate(some):
                table[:-1, g] = shrunk(*found, self.back, self.smoothing)
            self.last = ((languages.start, languages.stop), table)
        return self.last[1]

    def __getstate__(self) -> dict:
        return {**self.__dict__, "last": (None, None)}


@dataclass
class Model:
    languages: list[str]
    pieces: list[bytes]
    #: [piece, language] probabilities, and a last row of zeros for what is no piece.
    weights: np.ndarray | Sparse
    lattice: Lattice

    def scores(self, words: list[str]) -> np.ndarray:
        """[word, language]: log of the probability of each whole word, summed over its segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        data = [bytes_of(w) for w in words]
        for at in range(0, len(self.languages), TOGETHER):
            some = slice(at, at + TOGETHER)
            table = self.weights[some] if isinstance(self.weights, Sparse) else self.weights[:, some]
            for rows, text, lens in blocks_of(data, table.shape[1]):
                out[rows, some] = forward(text, self.lattice.edges(text), table)[lens, np.arange(len(text))]
        return out


def shrunk(piece: np.ndarray, seen: np.ndarray, back: np.ndarray, smoothing: float) -> np.ndarray:
    """Piece probabilities of a language from the expected numbers of the pieces seen in it."""
    p = smoothing * back
    p[piece] += seen
    return p / (seen.sum() + smoothing)


def expected(words: list[str], times: np.ndarray, p: np.ndarray, lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """(piece, expected number of it) over all segmentations of a language's words, each as often as it occurs."""
    n = len(p)
    p, log_p, seen = np.append(p, 0.0)[:, None], np.log(p), np.zeros(n + 1)
    for some, rows, lens in blocks_of([bytes_of(w) for w in words], 1):
        edges = lattice.edges(rows)
        alpha, beta = forward(rows, edges, p)[:, :, 0], backward(rows, lens, edges, p)[:, :, 0]
        total, w = alpha[lens, np.arange(len(rows))], times[some]
        for end, found in enumerate(edges):
            for begin, piece in found:
                hit = np.flatnonzero((piece < n) & (lens >= end))
                mass = np.exp(alpha[begin, hit] + log_p[piece[hit]] + beta[end, hit] - total[hit]) * w[hit]
                np.add.at(seen, piece[hit], mass)
    found = np.flatnonzero(seen[:n])
    return found, seen[found]


def background(pooled: np.ndarray) -> np.ndarray:
    """What every language is shrunk towards: half the pieces of all languages together, half the uniform distribution."""
    return 0.5 * pooled / max(pooled.sum(), 1e-300) + 0.5 / len(pooled)


def fit(counts: dict[str, dict[str, int]], pieces: list[bytes], rounds: int = 4, smoothing: float = 300.0) -> Model:
    """Expectation maximisation of piece probabilities on each language's word counts, in memory, for a few words.

    Every estimate is shrunk towards a mixture of the pooled pieces and the uniform distribution, so
    each byte keeps a probability and any text a score.
    """
    languages, lattice, n = sorted(counts), Lattice(pieces), len(pieces)
    p = [np.full(n, 1 / n)] * len(languages)
    for _ in range(rounds):
        seen = [expected(sorted(counts[g]), np.array([counts[g][w] for w in sorted(counts[g])], float), q, lattice) for g, q in zip(languages, p, strict=True)]
        pooled = np.zeros(n)
        for piece, mass in seen:
            pooled[piece] += mass
        p = [shrunk(piece, mass, background(pooled), smoothing) for piece, mass in seen]
    return Model(languages, pieces, np.vstack([np.array(p).T, np.zeros((1, len(languages)))]), lattice)


@lru_cache(maxsize=1)
def _lattice(pieces: tuple[bytes, ...]) -> Lattice:
    return Lattice(list(pieces))


_STATE = "lang string, word array<string>, n array<bigint>, piece array<int>, mass array<double>"


def fit_spread(words: DataFrame, pieces: list[bytes], rounds: int = 4, smoothing: float = 300.0) -> Model | None:
    """``fit`` of (lang, word, n) over the cluster; None without a word.

    A language's words are a row, so a round is a task's work for each language. What a round found is written to
    the shared folder; the driver sees one number a piece of it, and at the end the pieces seen in each language.
    """
    spark, n = words.sparkSession, len(pieces)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = words.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("w"))
    none = (F.array().cast("array<int>").alias("piece"), F.array().cast("array<double>").alias("mass"))
    state = stage(listed.select("lang", F.col("w.word").alias("word"), F.col("w.n").alias("n"), *none), "pieces")
    vocabulary = tuple(pieces)

    def step(back: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    times, piece, mass = (row.column(c)[0].values.to_numpy() for c in ("n", "piece", "mass"))
                    p = np.full(n, 1 / n) if back is None else shrunk(piece, mass, back, smoothing)
                    piece, mass = expected(row.column("word")[0].as_py(), times.astype(float), p, _lattice(vocabulary))
                    lists = [pa.array([piece.astype(np.int32)], pa.list_(pa.int32())), pa.array([mass], pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays([*row.columns[:3], *lists], ["lang", "word", "n", "piece", "mass"])

        return tidied(run)

    back = None
    for _ in range(rounds):
        before, state = state, stage(state.repartition(parts, "lang").mapInArrow(step(back), _STATE), "pieces")
        unstage(before)
        each = state.select("lang", F.explode(F.arrays_zip("piece", "mass")).alias("x")).select("lang", "x.piece", "x.mass")
        # in order of language, so that a rerun gives the same sums; the vocabulary bounds the rows
        summed = F.aggregate(F.sort_array(F.collect_list(F.struct("lang", "mass"))), F.lit(0.0), lambda a, x: a + x["mass"])
        found = each.groupBy("piece").agg(summed.alias("mass")).toArrow()
        pooled = np.zeros(n)
        pooled[found.column("piece").to_numpy()] = found.column("mass").to_numpy()
        back = background(pooled)
    found = state.select("lang", "piece", "mass").toArrow().sort_by("lang").combine_chunks()
    if not found.num_rows:
        return None
    seen = [(piece.values.to_numpy(), mass.values.to_numpy()) for piece, mass in zip(found.column("piece"), found.column("mass"), strict=True)]
    return Model(found.column("lang").to_pylist(), pieces, Sparse(seen, back, smoothing), Lattice(pieces))


def read_pieces(path: str) -> list[bytes]:
    """All byte pieces of a rank file; every single byte is among them."""
    with open(path, "rb") as f:
        found = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    return sorted({p for p in found if p} | {bytes([b]) for b in range(256)})


def _letters() -> list[str]:
    found = [(category_class("L", end), category_class("M", end)) for end in (0x80, 0x100, sys.maxunicode + 1)]
    return [f"[{letters}][{letters}{marks}]*" for letters, marks in found]


def sample_counts(docs: DataFrame, text: str, key: str, lang: str, usable: Column, docs_each: int, words_each: int) -> DataFrame:
    """(lang, word, n) of a sample of labelled documents: of each label ``docs_each`` documents and their ``words_each`` commonest words."""
    letters = _letters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Words(letters)
        for batch in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for value, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[name].update(find(value.as_py()))
            rows = [(g, w, n) for g, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])

    u = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    labelled = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = stage(labelled.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("of")), "labels")
    many = sizes.count()
    few = F.broadcast if many * docs_each <= 1_000_000 else lambda df: df  # labels, and ids of 8 bytes
    # ids are drawn before any text is read: only those below their language's share meet in a window
    drawn = labelled.select(F.col(lang).alias("lang"), F.col(key).alias("key"), u.alias("u")).join(few(sizes), "lang").where(F.col("u") < 1.5 * docs_each / F.col("of"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("u", "key"))
    ids = drawn.withColumn("rank", rank).where(F.col("rank") <= docs_each).select("key").distinct()
    drawn = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key")).join(few(ids), "key", "left_semi").select("text", "lang")
    words = drawn.mapInArrow(tidied(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    best = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return words.withColumn("best", best).where(F.col("best") <= words_each).drop("best")


def identify(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", lang: str = "lang", docs_each: int = SAMPLE_DOCS, words_each: int = SAMPLE_WORDS, along: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``, and the columns named in ``along``.

    Each language has a unigram distribution over the pieces of the public ``vocabulary`` file, all of
    them, fitted by expectation maximisation on a sample of labelled documents whose crc32 of the id as
    text is not 2 modulo 4; the others are held_out and never learned from. ``docs_each`` documents and
    ``words_each`` commonest words of each label bound the sample, any number of labels is learned. A
    text's score in a language is the probability of its whole words, of any length, summed over all
    their segmentations (forward algorithm); lang_pred is the best, score its posterior share under
    equal priors. All words of a text count; only the text is looked at.

    Texts that are null or have no letter give ``und`` and 0.0, as does everything if no labelled row can
    be learned from. A null id is never held out nor learned from. Ties go to the language that sorts first.
    Rows come back as often as they stand in ``docs``, and an empty table gives an empty one; nothing of
    them is shuffled. Other columns aren't looked at.
    """
    crc = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4))
    model = fit_spread(sample_counts(docs, text, key, lang, crc != 2, docs_each, words_each), read_pieces(vocabulary))
    letters, many = _letters(), len(model.languages) if model else 1
    most = max(1, min(CACHED_WORDS, CACHED_SCORES // many))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the model travels with the function: the pieces that the sample shows in each language
        find = Words(letters)
        place: dict[str, int] = {}
        cached = 0
        table = np.empty((0, many))

        def add(some: list[str]) -> None:
            nonlocal place, table, cached
            fresh = [w for w in some if w not in place]
            if len(place) + len(fresh) > most or cached > CACHED_BYTES:
                place, table, cached, fresh = {}, table[:0], 0, some
            if fresh:
                place.update(zip(fresh, range(len(place), len(place) + len(fresh)), strict=True))
                table = np.concatenate((table, model.scores(fresh)))
                cached += sum(map(len, fresh))

        def summed(words: list[list[str]]) -> np.ndarray:
            """[text, language]: the sums of the scores of each text's words, of which so many different ones at once as are remembered."""
            total = np.zeros((len(words), many))
            # texts in order and not their hashes, so that a rerun sums up in the same order
            different = list(dict.fromkeys(w for ws in words for w in ws))
            for begin in range(0, len(different), most):
                some = different[begin : begin + most]
                add(some)
                chosen = None if len(some) == len(different) else set(some)
                for i, ws in enumerate(words):
                    at = np.fromiter((place[w] for w in ws if chosen is None or w in chosen), np.int64)
                    for j in range(0, len(at), most):
                        total[i] += table[at[j : j + most]].sum(axis=0)
            return total

        for batch in batches:
            names, scores, at = [], [], 0
            while at < batch.num_rows:
                words, held = [], 0
                while at < batch.num_rows and held < min(2_000_000, 4 * most) and len(words) < max(1, CACHED_SCORES // many):
                    value = batch.column(1)[at].as_py() or ""
                    words.append(find(value) if model else [])
                    held += len(value)
                    at += 1
                for ws, total in zip(words, summed(words), strict=True):
                    if not ws:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    best = int(total.argmax())
                    names.append(model.languages[best])
                    scores.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
            made = [batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[3:]], ["doc_id", "held_out", "lang_pred", "score", *along])

    held = F.coalesce(crc == 2, F.lit(False))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), held.alias("held_out"), *[F.col(c).alias(f"along_{c}") for c in along])
    kinds = dict(docs.dtypes)
    return rows.mapInArrow(tidied(run), "doc_id long, held_out boolean, lang_pred string, score double" + "".join(f", `{c}` {kinds[c]}" for c in along))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
