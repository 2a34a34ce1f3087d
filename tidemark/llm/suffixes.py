"""Repeated passages: suffixes at content-chosen anchors, sorted by mergesort on prefix polynomial hashes.

Every window of ``length`` bytes has one anchor, its ``GRAM``-byte gram of least hash (the first of equals).
Which gram that is depends on the window's bytes alone, so equal windows have equal anchors at equal
offsets, and only windows whose anchor recurs can recur. Occurrences of a gram with the same surroundings
fold into the earliest of them; the suffixes and reversed prefixes of what remains are sorted, and common
extensions tell which windows are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import tidied

GRAM = 32
#: Contexts sorted together, and contexts of one gram beyond which its windows are compared one by one over the cluster.
BLOCK, LARGE = 20_000, 20_000
#: Positions that one pass over a text handles; passes overlap by a window.
SPAN = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 20) - 1)
#: Mark of an anchor's place: the batch of its scan has the same context earlier.
_TOLD = np.uint64(1 << 63)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _bytes_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Prefix polynomial hashes modulo 2**64 over randomised bytes; any substring's hash by one subtraction."""

    def __init__(self, n: int = SPAN + 4096):
        (self.up, self.down), self.table = _powers(n), _bytes_table(9)

    def prefixes(self, a: np.ndarray) -> np.ndarray:
        s = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(self.table[a] * self.up[: len(a)], out=s[1:])
        return s

    def hashes(self, s: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (s[end] - s[at]) * self.down[at]


def anchors(data: bytes, length: int, rolling: Rolling) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (gram hash, context digest in two halves, anchor, first window, last window), positions in ``data``.

    A context is the bytes of all windows of an anchor. Polynomial hashes only choose anchors and bring
    contexts together; that two contexts are equal is told by 128 bits of BLAKE2b.
    """
    n, wide, view = len(data), length - GRAM + 1, memoryview(data)
    everything = np.frombuffer(data, np.uint8)
    for begin in range(0, n - length + 1, SPAN):
        a = everything[begin : begin + SPAN + length - 1]
        s = rolling.prefixes(a)
        grams = len(a) - GRAM + 1
        gram = _mix((s[GRAM:] - s[:-GRAM]) * rolling.down[:grams])
        least, step = (gram & ~_LOW) | np.arange(grams, dtype=np.uint64), 1
        windows = grams - wide + 1
        while step * 2 <= wide:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        least = np.minimum(least[:windows], least[wide - step : wide - step + windows])
        at = (least & _LOW).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        pos, last = at[new], np.concatenate((new[1:] - 1, [windows - 1]))
        ranges = zip((new + begin).tolist(), (last + begin + length).tolist(), strict=True)
        digests = b"".join([hashlib.blake2b(view[i:j], digest_size=16).digest() for i, j in ranges])
        context, check = np.frombuffer(digests, "<u8").reshape(-1, 2).T
        yield gram[pos], context, check, pos + begin, new + begin, last + begin


class _Sorted:
    """Suffixes (rows of bytes with lengths) in order within their groups, and the common lengths of neighbours.

    Two suffixes are compared by binary search for the longest prefix with equal hashes, in a number of
    steps logarithmic in their length; runs are merged by each suffix's rank in its sister run. The
    result is verified on the bytes; were a hash to collide, plain byte order replaces it.
    """

    def __init__(self, rows: np.ndarray, lens: np.ndarray, group: np.ndarray, rolling: Rolling):
        self.rows, self.lens = rows, lens
        n, width = rows.shape
        self.hash = np.zeros((n, width + 1), np.uint64)
        np.cumsum(rolling.table[rows] * rolling.up[:width], axis=1, out=self.hash[:, 1:])
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1]))) if n else np.empty(0, np.int64)
        sizes = np.diff(np.concatenate((starts, [n])))
        base, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        order = self._merge(order, base, size)
        self.first = np.zeros(n, bool)
        self.first[starts] = True
        common = self._common(order[:-1], order[1:])
        true = self._by_bytes(order[:-1], order[1:])
        if not np.array_equal(common, true) or not self._ordered(order, true):
            keys = [self.rows[:, j].astype(np.int16) + 1 for j in range(width)]
            for j in range(width):
                keys[j][lens <= j] = 0
            order = np.lexsort([*reversed(keys), group])
            true = self._by_bytes(order[:-1], order[1:])
        self.order, self.common = order, np.concatenate(([0], true))

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(x), np.int64), np.minimum(self.lens[x], self.lens[y]).astype(np.int64)
        for _ in range(int(self.rows.shape[1]).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.hash[x, mid] == self.hash[y, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
            high = np.maximum(low, high)
        return low

    def _by_bytes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        differ = self.rows[x] != self.rows[y]
        at = np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1]) if differ.shape[1] else np.zeros(len(x), np.int64)
        return np.minimum(at, np.minimum(self.lens[x], self.lens[y]))

    def _sign(self, x: np.ndarray, y: np.ndarray, common: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as x stands before, with or after y."""
        at = np.minimum(common, self.rows.shape[1] - 1)
        end = common >= np.minimum(self.lens[x], self.lens[y])
        return np.sign(np.where(end, self.lens[x] - self.lens[y], self.rows[x, at].astype(np.int64) - self.rows[y, at]))

    def _ordered(self, order: np.ndarray, common: np.ndarray) -> bool:
        return bool((self.first[1:] | (self._sign(order[:-1], order[1:], common) <= 0)).all())

    def _merge(self, order: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
        width = 1
        while (at := np.flatnonzero(size > width)).size:
            inside = at - base[at]
            run = inside // width
            sister = np.minimum((run ^ 1) * width, size[at])
            low, end = sister.copy(), np.minimum(sister + width, size[at])
            high, odd, x = end.copy(), (run & 1).astype(bool), order[at]
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) >> 1
                y = order[base[at[open_]] + mid]
                sign = self._sign(y, x[open_], self._common(y, x[open_]))
                before = np.where(odd[open_], sign <= 0, sign < 0)
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            to = base[at] + (run & ~1) * width + (inside - run * width) + (low - sister)
            after = order.copy()
            after[to] = x
            order, width = after, width * 2
        return order

    def classes(self, least: int) -> np.ndarray:
        """A number for each suffix; equal where suffixes of a group agree in their first ``least`` bytes or more."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.first | (self.common < least))
        return out


def repeats(group: np.ndarray, doc: np.ndarray, start: np.ndarray, off: np.ndarray, texts: list[bytes], length: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset back from the anchor) of each window of a context that an earlier context of its group has too."""
    lens = np.array([len(t) for t in texts], np.int64)
    width = length + 1
    ends = np.cumsum(lens)
    flat, begin = np.frombuffer(b"".join(texts), np.uint8), ends - lens
    col = np.arange(width)
    at = (begin + off)[:, None] + col
    right_len = np.minimum(lens - off, width)
    right = np.where(col < right_len[:, None], flat[np.minimum(at, len(flat) - 1)], 0).astype(np.uint8)
    back = (begin + off)[:, None] - 1 - col[: length - GRAM + 1]
    left = np.where(col[: length - GRAM + 1] < off[:, None], flat[np.maximum(back, 0)], 0).astype(np.uint8)
    by_right, by_left = _Sorted(right, right_len, group, rolling), _Sorted(left, off, group, rolling)
    age = np.lexsort((start + off, doc))
    rows, backs = [], []
    for back in range(length - GRAM + 1):
        ok = age[(back <= off[age]) & (back >= off[age] - (lens[age] - length))]
        if len(ok) > 1:
            key = by_right.classes(length - back)[ok] * (len(doc) + 1) + by_left.classes(back)[ok]
            later = np.ones(len(ok), bool)
            later[np.unique(key, return_index=True)[1]] = False
            rows.append(ok[later])
            backs.append(np.full(int(later.sum()), back))
    return (np.concatenate(rows), np.concatenate(backs)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


_CANDIDATES = "doc long, kind int, gram long, pos int, lo int, hi int"


def _scan(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            parts = [[] for _ in range(5)]
            held = 0
            docs = batch.column(0).to_numpy()
            for i in np.argsort(docs, kind="stable"):
                doc = docs[i]
                for gram, context, check, pos, lo, hi in anchors(batch.column(1)[int(i)].as_py().encode("utf-8", "replace"), length, rolling):
                    where = (pos.astype(np.uint64) << np.uint64(20)) | ((pos - lo).astype(np.uint64) << np.uint64(10)) | (hi - lo).astype(np.uint64)
                    for part, x in zip(parts, (gram, context, check, np.full(len(pos), doc, np.int64), where), strict=True):
                        part.append(x)
                    held += len(pos)
                if held > 200_000:
                    yield _batch(parts)
                    parts, held = [[] for _ in range(5)], 0
            if held:
                yield _batch(parts)

    return run


def _batch(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    """Rows in order of document and place, where a context that the same batch has earlier is told at once.

    Such a row needs no look at others of its gram, so it is marked in ``at`` and dealt by its own place.
    A gram that is very common then brings one row for each of its contexts and batches to one task.
    """
    gram, context, check, doc, at = (np.concatenate(p) for p in parts)
    order = np.argsort(gram + context * np.uint64(_BASE), kind="stable")
    later = order[1:][~_differ(*(x[order] for x in (gram, context, check)))]
    gram[later] = _mix((doc[later].view(np.uint64) * np.uint64(_BASE)) ^ at[later])
    context[later] = check[later] = 0
    at[later] |= _TOLD
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (gram, context, check, doc, at)], ["gram", "context", "check", "doc", "at"])


def _differ(*columns: np.ndarray) -> np.ndarray:
    """Whether each row but the first differs from the one before it."""
    return np.logical_or.reduce([x[1:] != x[:-1] for x in columns])


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of gram, context, check, document, place -> candidates of recurring grams.

    kind 0: a context that occurs earlier; all its windows repeat. 1: the first of its context, in a
    gram with several contexts. 2: the same, in a gram with more than LARGE of them. Rows marked by the
    scan are of kind 0, whatever stands beside them. Grams may span batches: the last one of a batch waits for the next, and of a gram beyond LARGE only what is new.
    """

    def told(gram, doc, at, kind):
        pos = at >> np.uint64(20)
        lo = pos - ((at >> np.uint64(10)) & np.uint64(1023))
        hi = lo + (at & np.uint64(1023))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(kind.astype(np.int32)), pa.array(np.where(kind == 0, 0, gram)), *(pa.array(x.astype(np.int32)) for x in (pos, lo, hi))],
            ["doc", "kind", "gram", "pos", "lo", "hi"],
        )

    def sifted(rows):
        gram, context, check, doc, at = rows
        if not len(gram):
            return None
        new_gram = np.concatenate(([True], _differ(gram)))
        new = new_gram | np.concatenate(([True], _differ(context, check)))
        which = np.cumsum(new_gram) - 1
        contexts = np.bincount(which, weights=new)[which]
        keep = ~new | (contexts > 1)
        kind = np.where(new, np.where(contexts > LARGE, 2, 1), 0)
        return told(*(x[keep] for x in (gram, doc, at, kind)))

    wait = [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)]
    large = None  # (gram, context, check) last seen of a gram that is known to be large
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        rows[4] = rows[4].view(np.uint64)
        marked = rows[4] >= _TOLD
        if marked.any():
            yield told(rows[0][marked], rows[3][marked], rows[4][marked] ^ _TOLD, np.zeros(int(marked.sum()), np.int32))
            rows = [x[~marked] for x in rows]
        if not len(rows[0]):
            continue
        if large is not None:
            of = int(np.searchsorted(rows[0], large[0], side="right")) if rows[0][0] == large[0] else 0
            if of:
                new = _differ(*(np.concatenate(([before], x[:of])) for before, x in zip(large[1:], rows[1:3], strict=True)))
                yield told(rows[0][:of], rows[3][:of], rows[4][:of], np.where(new, 2, 0))
                large = (large[0], rows[1][of - 1], rows[2][of - 1])
                rows = [x[of:] for x in rows]
            if not len(rows[0]):
                continue
            large = None
        rows = [np.concatenate(x) for x in zip(wait, rows, strict=True)]
        cut = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
        if cut and (out := sifted([x[:cut] for x in rows])):
            yield out
        wait = [x[cut:] for x in rows]
        if 1 + int(_differ(*wait[1:3]).sum()) > LARGE:
            yield sifted(wait)
            large = (wait[0][-1], wait[1][-1], wait[2][-1])
            wait = [x[:0] for x in wait]
        elif len(wait[0]) > 4 * LARGE:  # mostly copies: these are told at once, the firsts wait
            later = np.concatenate(([False], ~_differ(*wait[1:3])))
            last = later.copy()
            last[:-1] = False
            gone = later & ~last
            yield told(*(wait[i][gone] for i in (0, 3, 4)), np.zeros(int(gone.sum()), np.int32))
            wait = [x[~gone] for x in wait]
    if (out := sifted(wait)) is not None:
        yield out


def _cut(length: int):
    """Texts with their candidates of kinds 1 and 2 -> contexts, or for kind 2 hashes of single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, names = Rolling(), ["gram", "kind", "doc", "lo", "off", "bytes"]

        def made(gram, kind, doc, lo, off, part):
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((gram, kind, doc, lo, off, part), types, strict=True)], names)

        for batch in batches:
            out = [[] for _ in range(6)]
            for doc, value, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = value.as_py().encode("utf-8", "replace")
                for c in found:
                    if c["kind"] == 1:
                        rows = [(c["gram"], 1, doc, c["lo"], c["pos"] - c["lo"], data[c["lo"] : c["hi"] + length])]
                    else:
                        rows = []
                        for s in range(c["lo"], c["hi"] + 1):
                            h = hashlib.blake2b(data[s : s + length], digest_size=16).digest()
                            rows.append((int.from_bytes(h[:8], "little", signed=True), 2, doc, s, 0, h))
                    for row in rows:
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
                if len(out[0]) >= BLOCK:
                    yield made(*out)
                    out = [[] for _ in range(6)]
            if out[0]:
                yield made(*out)
        del rolling

    return run


def _compare(length: int):
    """Contexts in order of gram -> the spans of windows that an earlier context has too; whole grams at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(4096)

        def spans(rows: pa.Table) -> pa.RecordBatch:
            gram, doc, lo, off = (rows.column(c).to_numpy() for c in ("gram", "doc", "lo", "off"))
            _, group = np.unique(gram, return_inverse=True)
            row, back = repeats(group, doc, lo.astype(np.int64), off.astype(np.int64), rows.column("bytes").to_pylist(), length, rolling)
            at = lo[row].astype(np.int64) + off[row] - back
            order = np.lexsort((at, row))
            row, at = row[order], at[order]
            if not len(row):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int32())], ["doc", "begin", "end"])
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)))
            first, last = np.flatnonzero(new), np.concatenate((np.flatnonzero(new)[1:] - 1, [len(row) - 1]))
            return pa.RecordBatch.from_arrays([pa.array(doc[row[first]]), pa.array(at[first].astype(np.int32)), pa.array((at[last] + length).astype(np.int32))], ["doc", "begin", "end"])

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                table = pa.Table.from_batches(held).combine_chunks()
                gram = table.column("gram").to_numpy()
                cut = int(np.flatnonzero(gram != gram[-1])[-1] + 1) if gram[0] != gram[-1] else 0
                if cut:
                    yield spans(table.slice(0, cut).combine_chunks())
                    held = table.slice(cut).combine_chunks().to_batches()
                    n -= cut
        if n:
            yield spans(pa.Table.from_batches(held).combine_chunks())

    return run


def _merge_spans(begin: list[int], end: list[int], n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for b, e in sorted(zip(begin, end, strict=True)):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, min(e, n)) for b, e in out]


def _finish(whole_characters: bool, along: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0)
            n, gone, many, digest, kept = [], [], [], [], []
            for value, copy, found in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = (value.as_py() or "").encode("utf-8", "replace")
                spans = [(0, len(data))] if copy and data else _merge_spans([x["begin"] for x in found or ()], [x["end"] for x in found or ()], len(data))
                at, parts = 0, []
                removed = sum(e - b for b, e in spans)
                runs = len(spans)
                for b, e in spans:
                    if whole_characters:
                        while b < e and data[b] & 0xC0 == 0x80:
                            b += 1
                        while e > b and e < len(data) and data[e] & 0xC0 == 0x80:
                            e -= 1
                    parts.append(data[at:b])
                    at = e
                rest = b"".join((*parts, data[at:]))
                n.append(len(data))
                gone.append(removed)
                many.append(runs)
                digest.append(None if whole_characters else hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode() if whole_characters else None)
            made = [pa.array(x, t) for x, t in ((n, pa.int64()), (gone, pa.int64()), (many, pa.int64()), (digest, pa.string()), (kept, pa.string()))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *along]
            yield pa.RecordBatch.from_arrays([doc, *made, *batch.columns[4:]], names)

    return run


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 100, texts: bool = False, along: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text of every document of ``docs``.

    A byte goes when a string of ``length`` UTF-8 bytes that covers it also starts earlier: in a smaller
    doc_id, or before in the same document. Strings are judged on the input; ``length`` may be 64 to 1000.
    With ``texts``, kept_text is what is left, where a character goes only if all its bytes do, and the
    digest is null; otherwise kept_text is null and the digest covers the exact bytes left.

    A copy of a whole document goes by its digest, before anything is compared. Null and empty texts have
    0 bytes and spans. Rows that share an id are one document with the least of their texts (of equal ones
    the least in the columns ``along``), and come back once. Rows without an id come back one by one,
    unchanged. An empty table gives an empty one. Columns named in ``along`` come along, appended to the
    result; other columns aren't looked at, whatever their names.
    """
    if not 2 * GRAM <= length <= 1000:
        raise ValueError(f"length {length} isn't in {2 * GRAM}..1000")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), F.struct(F.lit(0).alias("_"), *along).alias("more"))
    # one exchange of the texts, by document, serves the digests, the scan, the cutting out of contexts and the result
    whole = F.min(F.struct(F.col("text").isNull(), "text", "more")).alias("m")
    dealt = rows.where("doc is not null").repartition(parts, "doc").groupBy("doc").agg(whole).select("doc", "m.text", "m.more")
    thin = dealt.select("doc", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).alias("n"))
    first = thin.groupBy("digest").agg(F.min("doc").alias("origin"))
    copies = thin.where(F.col("n") >= length).join(first, "digest").where("doc <> origin").select("doc")
    origin = dealt.join(copies, "doc", "left_anti").where(F.octet_length("text") >= length)
    grams = origin.select("doc", "text").mapInArrow(tidied(_scan(length)), "gram long, context long, check long, doc long, at long")
    candidates = grams.repartition(parts, "gram").sortWithinPartitions("gram", "context", "check", "doc", "at").mapInArrow(tidied(_sift), _CANDIDATES).repartition(parts, "doc")
    listed = candidates.where("kind > 0").groupBy("doc").agg(F.collect_list(F.struct("kind", "gram", "pos", "lo", "hi")).alias("found"))
    cut = dealt.join(listed, "doc").select("doc", "text", "found").mapInArrow(tidied(_cut(length)), "gram long, kind int, doc long, lo int, off int, bytes binary")
    cut = cut.repartition(parts, "gram", F.when(F.col("kind") == 2, F.col("doc")))
    near = cut.where("kind = 1").sortWithinPartitions("gram").mapInArrow(tidied(_compare(length)), "doc long, begin int, end int")
    single = cut.where("kind = 2").select("bytes", F.struct("doc", F.col("lo").alias("begin")).alias("w"))
    earliest = single.groupBy("bytes").agg(F.min("w").alias("first"))
    far = single.join(earliest, "bytes").where("w <> first").select("w.doc", "w.begin", (F.col("w.begin") + length).alias("end"))
    full = candidates.where("kind = 0").select("doc", F.col("lo").alias("begin"), (F.col("hi") + length).alias("end"))
    spans = full.union(near).union(far).groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("found"))
    beside = [F.col("more")[c].alias(f"along_{c}") for c in along]
    marked = dealt.join(copies.withColumn("copy", F.lit(True)), "doc", "left").join(spans, "doc", "left").select("doc", "text", "copy", "found", *beside)
    nothing = (F.lit(None).cast("boolean").alias("copy"), F.lit(None).cast(marked.schema["found"].dataType).alias("found"))
    unnamed = rows.where("doc is null").select("doc", "text", *nothing, *beside)
    kinds = dict(docs.dtypes)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string" + "".join(f", `{c}` {kinds[c]}" for c in along)
    return marked.union(unnamed).mapInArrow(tidied(_finish(texts, along)), schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
