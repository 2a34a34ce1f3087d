"""Byte-pair encoding of whole texts by a traversal of the trie of their distinct words."""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import tidied
from tidemark.llm.text import WHITE_SPACE, category_class

#: Characters of text worked on at once, and words whose encodings a task remembers before it starts afresh.
CHUNK, CACHED_WORDS = 1_000_000, 300_000
#: Pairs of tokens whose merging a task remembers before it starts afresh.
CACHED_PAIRS = 500_000
_NEVER = 1 << 60


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: Latin-1's visible characters, then U+0100 onwards."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BytePairs:
    """Tables of a byte-level vocabulary, and encodings of words through the prefixes they share.

    The encoding of a prefix is that of a shorter prefix and one last token. Which last token is right is
    decided by two tokens alone: the last of the shorter prefix and the candidate must stay apart when
    byte pairs merge. So a depth-first walk over the trie of sorted words settles each prefix once.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        plain = _byte_characters()
        self.bytes_of = {i: bytes(plain[c] for c in s) for s, i in vocabulary.items()}
        self.bytes_of.update((i, s.encode()) for s, i in special.items())
        n = max(self.bytes_of) + 1
        self.made, self.left, self.right = [-1] * n, [0] * n, [0] * n
        self.rank: dict[tuple[int, int], int] = {}
        self.id_of = {b: vocabulary[c] for c, b in ((c, bytes([b])) for c, b in plain.items()) if c in vocabulary}
        for r, (x, y) in enumerate(merges):
            a, b, c = vocabulary[x], vocabulary[y], vocabulary[x + y]
            if self.made[c] >= 0:
                raise ValueError(f"two merges make {x + y!r}")
            self.made[c], self.left[c], self.right[c], self.rank[a, b] = r, a, b, r
            self.id_of[self.bytes_of[c]] = c
        # by the last three bytes of a prefix, the lengths that a token at its end can have
        tails: dict[bytes, set[int]] = {}
        for b in self.id_of:
            if len(b) > 2:
                tails.setdefault(b[-3:], {1, 2}).add(len(b))
        self.tails = {b: tuple(sorted(n, reverse=True)) for b, n in tails.items()}
        self.apart: dict[tuple[int, int], bool] = {}

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the tokens a and b, side by side, are the encoding of their bytes.

        Goes back in time: the later made of the two pieces at the border is undone until both are bytes.
        They would have merged where their pair has a rank below that at which either was used up; of
        equal pairs the leftmost merges first.
        """
        made, rank, key = self.made, self.rank, (a, b)
        a_until = b_until = _NEVER
        while True:
            r = rank.get((a, b))
            if r is not None and r < a_until and r <= b_until:
                out = False
                break
            if made[a] > made[b]:
                a_until, a = made[a], self.right[a]
            elif made[b] >= 0:
                b_until, b = made[b], self.left[b]
            else:
                out = True
                break
        if len(self.apart) > CACHED_PAIRS:
            self.apart.clear()
        self.apart[key] = out
        return out

    def encode_words(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with its ids, in byte order."""
        id_of, apart, tails, short = self.id_of, self.apart, self.tails, (2, 1)
        before, last, size = b"", [], []
        for word in sorted(words):
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del last[depth:], size[depth:]
            for end in range(depth + 1, len(word) + 1):
                for n in tails.get(word[end - 3 : end], short) if end > 2 else short:
                    token = id_of.get(word[end - n : end]) if n <= end else None
                    if token is None:
                        continue
                    if n == end:
                        break
                    pair = (last[end - n - 1], token)
                    ok = apart.get(pair)
                    if self.stay_apart(*pair) if ok is None else ok:
                        break
                last.append(token)
                size.append(n)
            at, ids = len(word), []
            while at:
                ids.append(last[at - 1])
                at -= size[at - 1]
            ids.reverse()
            before = word
            yield word, ids


class Encoder:
    """Texts to packed ids and back; remembers the words of a task."""

    def __init__(self, pairs: BytePairs, patterns: list[str], special: dict[str, int]):
        self.pairs, self.special = pairs, special
        self.patterns = [re.compile(p).findall for p in patterns]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else lambda t: [t]
        self.ids: dict[str, bytes] = {}
        known = [pairs.bytes_of.get(i, b"") for i in range(len(pairs.made))]
        self.size = np.array([len(b) for b in known], np.int64)
        self.place, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(known), np.uint8)

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.patterns[0](text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.patterns[2](text)
        return self.patterns[1](text)

    def __call__(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """The ids of each text as little-endian unsigned 32-bit integers, and the bytes they decode to."""
        if len(self.ids) > CACHED_WORDS:
            self.ids.clear()
        cut = [[(part, None) if part in self.special else (part, self.words(part)) for part in self.cut(text)] for text in texts]
        fresh = {w for parts in cut for _, words in parts if words for w in words} - self.ids.keys()
        named = {w.encode("utf-8", "replace"): w for w in fresh}
        for word, ids in self.pairs.encode_words(list(named)):
            self.ids[named[word]] = struct.pack(f"<{len(ids)}I", *ids)
        for parts in cut:
            ids = []
            for part, words in parts:
                if words is None:
                    ids.append(struct.pack("<I", self.special[part]))
                else:
                    ids.extend(map(self.ids.__getitem__, words))
            packed = b"".join(ids)
            yield packed, self.decode(packed)

    def decode(self, packed: bytes) -> bytes:
        """The bytes of all tokens, gathered from one table."""
        ids = np.frombuffer(packed, "<u4")
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.place[ids] - (ends - size), size)
        at += np.arange(len(at))
        return self.flat[at].tobytes()


def read_vocabulary(path: str) -> tuple[dict[str, int], list[tuple[str, str]], dict[str, int]]:
    """(vocabulary, merges, special tokens) of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in made["model"]["merges"]]
    return made["model"]["vocab"], merges, {t["content"]: t["id"] for t in made["added_tokens"]}


def split_patterns() -> list[str]:
    """The split of byte-level pre-tokenizers in classes that re knows: for ASCII, Latin-1 and any text."""
    return [_split_pattern(category_class("L", end), category_class("N", end), WHITE_SPACE[end]) for end in (0x80, 0x100, sys.maxunicode + 1)]


def _split_pattern(letter: str, number: str, space: str) -> str:
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


def encode_texts(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", keep: bool = True, back: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded of every row of ``docs``.

    ids are little-endian unsigned 32-bit integers in a binary; decoded is the text that they give, with
    U+FFFD where tokens cut a character. Both are null unless ``keep``, decoded also unless ``back``. The literal of a special token in
    a text becomes that token. ``tokenizer`` is a file on the driver; its tables travel with the tasks.
    Rows stay where they are: nothing is shuffled.

    Null texts count as empty: no ids. Repeated rows come back as often, null ids as null; other columns
    aren't looked at. Texts of any length are encoded whole.
    """
    vocabulary, merges, special = read_vocabulary(tokenizer)
    patterns = split_patterns()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # millions of live strings and no cycles
        encode = None
        for batch in batches:
            encode = encode or Encoder(BytePairs(vocabulary, merges, special), patterns, special)
            at = 0
            while at < batch.num_rows:
                texts, held, begin = [], 0, at
                while at < batch.num_rows and held < CHUNK:
                    texts.append(batch.column(1)[at].as_py() or "")
                    held += len(texts[-1])
                    at += 1
                n, ids_hash, back_hash, ids, texts_back = [], [], [], [], []
                for packed, raw in encode(texts):
                    n.append(len(packed) // 4)
                    ids_hash.append(hashlib.sha256(packed).hexdigest())
                    decoded = raw.decode("utf-8", "replace")
                    back_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
                    ids.append(packed if keep else None)
                    texts_back.append(decoded if keep and back else None)
                columns = ((n, pa.int64()), (ids_hash, pa.string()), (back_hash, pa.string()), (ids, pa.binary()), (texts_back, pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, at - begin), *(pa.array(x, t) for x, t in columns)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), keep=False).drop("ids", "decoded")
