"""Periodic runs against all stretches by definition: powers, overlaps, long texts in ranges, odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import periods


def brute_runs(w, shortest=24, times=3):
    """Each stretch that can't grow, at each period; of equal stretches only the smallest period is one."""
    n, found = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            if length >= max(shortest, times * q) and not any(all(w[j] == w[j + p] for j in range(start, start + length - p)) for p in range(1, q)):
                found[start, q] = (start, length, q)
    return [found[k] for k in sorted(found)]


def brute(doc, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    one = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc, len(runs), *one, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def sequences():
    rng = random.Random(4)
    yield from ([], [1] * 23, [1] * 24, [1] * 100, [1, 2] * 12, [1, 2] * 11 + [1, 3], list(range(8)) * 3, list(range(9)) * 3, (list(range(9)) * 3)[:-1], list(range(40)) * 2)
    yield ([1] * 30 + [2]) * 5  # a period of many runs of period 1
    yield ([1, 2] * 15 + [3]) * 4 + [1, 2] * 15
    yield [1, 1, 2] * 9 + [1, 1] + [2, 1] * 14
    for _ in range(150):
        w = []
        while len(w) < rng.randrange(20, 260):
            piece = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 30))]
            w += piece * rng.choice([1, 1, 2, 3, 4, 9])
        yield w


def test_all_lags():
    for w in sequences():
        ids = np.array(w, np.int32)
        assert sorted(periods.runs_of(ids), key=lambda r: (r[0], r[2])) == brute_runs(w)
    for w in list(sequences())[:60]:
        got = sorted(periods.runs_of(np.array(w, np.int32), 5, 2), key=lambda r: (r[0], r[2]))
        assert got == brute_runs(w, 5, 2)


def test_lag_ranges():
    several = 0
    for w in sequences():
        ranges = periods.lag_ranges(len(w), size=40)
        assert [a for a, _ in ranges][1:] == [b + 1 for _, b in ranges][:-1] and ranges[0][0] == 1 and ranges[-1][1] == max(1, len(w) // 3)
        several += len(ranges) > 1
        parts = [r for a, b in ranges for r in periods.runs_of(np.array(w, np.int32), low=a, high=b, known=3)]
        assert sorted(parts, key=lambda r: (r[0], r[2])) == brute_runs(w)
    assert several > 20
    assert len(periods.lag_ranges(periods.long_text() // 2 + 1)) > 1 and len(periods.lag_ranges(periods.long_text() // 2)) == 1


@pytest.mark.parametrize("size", [50_000, 40])
def test_periodic_runs(spark, monkeypatch, size):
    monkeypatch.setattr(periods, "RANGE", size)
    rows = [(i, " \n"[i % 2].join(f"w{x}é" for x in w)) for i, w in enumerate(sequences())]
    rows += [(900, None), (901, " \t\n"), (902, "a b " * 24), (None, "no id " * 20), (3, rows[3][1]), (3, "x " * 50), (904, "\x0bone\x0ctwo " * 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("nr", F.lit(1)).withColumn("runs", F.lit("x")).repartition(3)
    got = []
    for r in periods.periodic_runs(df).collect():
        lines = "".join(f"{x.start},{x.length},{x.period}\n" for x in r.runs)
        got.append((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(r.collapsed).hexdigest()))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted((brute(i, t, False) for i, t in rows), key=key)
    assert periods.periodic_runs(df.limit(0)).count() == 0


def test_op13(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["a", "bé", "c", "d e", "f"]) for _ in range(rng.randrange(0, 150)))) for i in range(300)] + [(1000 + i, t) for i, t in enumerate([None, "", "  \n"] * 12)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 20
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in periods.op13_periods(spark, str(tmp_path)).collect())
    assert got == sorted(brute(i, t) for i, t in rows) and sum(r[1] > 0 for r in got) > 10
    monkey = periods.RANGE
    periods.RANGE = 60
    try:
        assert sorted(tuple(r) for r in periods.op13_periods(spark, str(tmp_path)).collect()) == got
    finally:
        periods.RANGE = monkey
