"""Corpus operators against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, language, licenses, minhash, mixing, suffixes, topk, urls, vectors, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=60, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(n)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    for i in range(0, n, 6):
        texts[i] += "\n" + shared + " é" * (i % 4)
    for i in range(1, n, 7):
        t = texts[i - 1].split(" ")
        t[len(t) // 2] = "CHANGED"
        texts[i] = " ".join(t)
    texts += [None, "", "   \n", texts[3], texts[3], "one two", "ONE\ttwo", "ab" * 200]
    return [(i, t, "en", "s%d" % (i % 3) if i % 5 else None, 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame(rows + [rows[3], (None, "no id at all", None, None, 0)], DOCS).withColumn("text_a", F.lit(1)).withColumn("sig", F.lit(2))


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_minhash(docs):
    sets = {r[0]: shingle_set(r[1]) for r in corpus()}
    root = {k: k for k in sets}
    for a, b in itertools.combinations(sets, 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if v == old else v for k, v in root.items()}
    got = minhash.near_duplicates(docs, percent=85).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {(k, len(s), root[k], root[k] == k) for k, s in sets.items()}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] and len(got) == len(sets) + 2
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def removed(rows, size=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if b[s : s + size] in seen:
                gone[s : s + size] = b"\1" * size
            seen.add(b[s : s + size])
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("large", [20_000, 2])
def test_suffixes(docs, large, monkeypatch):
    monkeypatch.setattr(suffixes, "LARGE", large)
    want = removed([r[:2] for r in corpus()])
    got = {r.doc_id: tuple(r)[1:5] for r in suffixes.remove_repeats(docs).collect()}
    none = got.pop(None)
    assert got == want and none[1] == 0


def test_suffixes_of_repeated_ids(spark):
    x, y = "a" + "".join(map(chr, range(0x100, 0x180))), "b" + "".join(map(chr, range(0x200, 0x280)))
    for rows, want in (([(5, x), (5, y), (7, y)], {5: x, 7: y}), ([(2, y), (5, x), (5, y)], {2: y, 5: x}), ([(5, x), (5, None), (7, x)], {5: x, 7: ""})):
        got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), texts=True).collect()
        assert {r.doc_id: r.kept_text for r in got} == want


@pytest.mark.parametrize("large", [20_000, 2])
def test_common_line_in_many_batches(spark, large, monkeypatch):
    """A line of most documents is told within batches, between them and, across its border, by its neighbours."""
    monkeypatch.setattr(suffixes, "LARGE", large)
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(130))
    rest = lambda: "".join(rng.choice("ijklmnop ") for _ in range(rng.randrange(0, 150)))
    rows = [(i, rest() + line * (1 + (i % 9 == 0) * 3) + rest()[: i % 3 * 20]) for i in range(200)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = {r.doc_id: tuple(r)[1:5] for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == removed(rows)


def test_suffix_order():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (300, 40)).astype(np.uint8)
    lens, group = rng.integers(0, 41, 300), rng.integers(0, 4, 300)
    rows[np.arange(40) >= lens[:, None]] = 0
    s = suffixes._Sorted(rows, lens, group, suffixes.Rolling(4096))
    keys = [(group[i], bytes(rows[i, : lens[i]])) for i in s.order]
    assert keys == sorted(keys)


def test_bpe_is_the_library(docs, spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_path())
    odd = ["a<|endoftext|>b", " \u3000\xa0 x\n\n y", "I'll ²Ⅷ½ ٣\x1c\x85z漢字 🙂 नमस्ते", "a" * 3000]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    for r in bpe.encode_texts(df, bpe.tokenizer_path()).join(df.withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d")).collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.decoded == library.decode(want, skip_special_tokens=False) and r.n_tokens == len(want)


def test_language(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "ing", "and", "th"], "de": ["der", "sch", "und", "ung"], "fr": ["eau", "les", "é", "que"]}
    rows = [(i, " ".join("".join(rng.choice(parts[g]) for _ in range(2)) for _ in range(30)), g) for i, g in enumerate(["en", "de", "fr"] * 60)]
    rows += [(900, None, "en"), (901, "12 !?", None), (None, "the und", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df, language.vocabulary_path()).collect()}
    held = [i for i, r in got.items() if r.held_out and i is not None and i < 900]
    assert held and all(got[i].lang_pred == rows[i][2] for i in held)
    assert (got[900].lang_pred, got[901].lang_pred, got[901].score) == ("und", "und", 0.0) and not got[None].held_out
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", F.lit(None).cast("string")), language.vocabulary_path()).collect()} == {"und"}


def segmentations(word, prob):
    """Log of the summed probability of all segmentations, place by place with logarithms."""
    at = [0.0] + [None] * len(word)
    for end in range(1, len(word) + 1):
        terms = [at[begin] + math.log(prob[word[begin:end]]) for begin in range(end) if word[begin:end] in prob]
        top = max(terms)
        at[end] = top + math.log(sum(math.exp(t - top) for t in terms))
    return at[-1]


def test_language_sums_all_segmentations():
    """Whole words beyond 24 bytes, pieces beyond 12, any script, none too long."""
    pieces = language.read_pieces(language.vocabulary_path())
    assert len(pieces) > 50_000 and max(map(len, pieces)) > 100
    rng = np.random.default_rng(4)
    p = np.vstack([rng.dirichlet(np.full(len(pieces), 0.3), 2).T + 1e-12, np.zeros((1, 2))])
    model = language.Model(["a", "b"], pieces, p, language.Lattice(pieces))
    words = ["a", "abc", "telecommunications", "donaudampfschifffahrtskapitän", "rawdownloadcloneembedreportprint", "превысокомногорассмотрительствующий", "नमस्तेदुनिया", "サーティワン", "漢字" * 40, "ab" * 700, "naïveté"]
    got = model.scores(words)
    for g in (0, 1):
        prob = dict(zip(pieces, p[:, g], strict=False))
        assert got[:, g] == pytest.approx([segmentations(language.bytes_of(w), prob) for w in words], rel=1e-9)


def test_language_fit_is_expectation_maximisation():
    """One round by hand: expected piece counts over all segmentations of each word, then shrinkage."""
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b" a"]
    counts = {"x": {"abc": 3, "ab" * 20: 1}, "y": {"cba": 2}}
    model = language.fit(counts, pieces, rounds=1, smoothing=1.0)
    n = len(pieces)
    seen = np.zeros((n, 2))
    for g, name in enumerate(("x", "y")):
        for word, times in counts[name].items():
            b = language.bytes_of(word)
            ahead, behind = [0.0] * (len(b) + 1), [0.0] * (len(b) + 1)
            ahead[0] = behind[-1] = 1.0
            edges = [(i, j, pieces.index(b[i:j])) for i in range(len(b)) for j in range(i + 1, len(b) + 1) if b[i:j] in pieces]
            for i, j, _ in sorted(edges, key=lambda e: e[1]):
                ahead[j] += ahead[i] / n
            for i, j, _ in sorted(edges, key=lambda e: -e[0]):
                behind[i] += behind[j] / n
            for i, j, k in edges:
                seen[k, g] += times * ahead[i] / n * behind[j] / ahead[-1]
    back = 0.5 * seen.sum(axis=1) / seen.sum() + 0.5 / n
    assert model.weights[:n] == pytest.approx((seen + back[:, None]) / (seen.sum(axis=0) + 1.0), rel=1e-9)


def test_language_edges(spark):
    rows = [(1, "the the", "en"), (1, "the the", "en"), (2, "12 !?", "en"), (3, "der " * 50_000, "de"), (4, "der die", "de"), (5, "", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("held_out", F.lit(1))
    got = language.identify(df, language.vocabulary_path(), along=("lang",)).collect()
    assert sorted((r.doc_id, r.lang) for r in got) == sorted((i, g) for i, _, g in rows)
    assert {r.lang_pred for r in got if r.doc_id in (2, 5)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert language.identify(df.limit(0), language.vocabulary_path()).count() == 0
    # of equal scores the language that sorts first: nothing tells two languages with one sample apart
    learned = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2][:40]
    twin = spark.createDataFrame([(i, "same words", "ba"[n % 2]) for n, i in enumerate(learned)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.identify(twin, language.vocabulary_path()).collect()} == {("a", 0.5)}


def test_mixing(docs):
    got = mixing.mix(docs.where("doc_id is not null")).collect()
    again = mixing.mix(docs.where("doc_id is not null").repartition(5)).collect()
    key = lambda rows: sorted((r.doc_id, r.taken) for r in rows)
    assert key(got) == key(again) and all(r.taken <= 2 * r["size"] for r in got)
    per = {}
    for r in got:
        per.setdefault(r.source, [r.target, 0, 0, 0])
        per[r.source][1] += r.taken
        per[r.source][2] += r["size"]
        per[r.source][3] = max(per[r.source][3], r["size"])
    assert sum(v[0] for v in per.values()) == pytest.approx(1.5 * sum(v[2] for v in per.values()))
    assert all(abs(v[1] - v[0]) <= v[3] and v[0] <= 2 * v[2] + 1e-6 for v in per.values())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/", "x"), (1, None, "x"), (2, "u\r\nv", None), (5, "u", ""), (None, "n", "x"), (7, "u", "é")]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {r.record_id: r for r in warc.read_archive(spark, str(tmp_path / "w")).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in got.items()} == {3: ("revisit", 1, 1), 1: ("response", None, 1), 2: ("response", None, 0), 5: ("revisit", 2, 0), None: ("response", None, 1), 7: ("response", None, 2)}
    assert spark.read.parquet(str(tmp_path / "w" / "payloads")).count() == 3
    raw = {r.record_id: bytes(r.record) for r in warc.record_bytes(warc.read_archive(spark, str(tmp_path / "w"))).collect()}
    assert raw[7].startswith(b"WARC/1.1\r\n") and raw[7].endswith(b"\r\n\r\n" + "é".encode() + b"\r\n\r\n")


def test_licenses(spark):
    mit = "Copyright (c) 2020 X\n\n" + licenses.KNOWN["MIT"].upper().replace(" ", "\n")
    df = spark.createDataFrame([(1, mit), (2, "some " + mit), (3, None), (4, "released under the MIT licence")], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan_licenses(df).collect()} == {1: "MIT", 2: None, 3: None, 4: "notice-MIT"}


def test_known_licenses_are_found(spark):
    """Every known text as a whole, and within a longer one, with other case, spelling, breaks and copyright lines."""
    full = licenses.known_texts()
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "MIT", "BSD-3-Clause"} <= set(full)
    names = sorted(full)
    rows = [(i, full[n].replace(" license ", " Licence ").upper()) for i, n in enumerate(names)]
    rows += [(1000 + i, "Some words\n\nCopyright (c) 2001 X\n\n" + full[n] + "\n\nand more") for i, n in enumerate(names)]
    rows += [(2000, "a\n" + licenses.KNOWN["notice-MIT"] + "\nb"), (2001, None), (2002, ""), (2003, "unreleased under the MIT License."), (None, full["Zlib"]), (None, full["Zlib"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("license", F.lit(2))
    got = licenses.scan_licenses(df).collect()
    assert len(got) == len(rows) and [r.license for r in got if r.doc_id is None] == ["Zlib", "Zlib"]
    told = {r.doc_id: r for r in got}
    assert all(told[i].license == n and n in told[i].licenses and told[1000 + i].license is None and n in told[1000 + i].licenses for i, n in enumerate(names))
    assert told[2000].licenses == ["notice-MIT"] and told[2001].licenses == told[2002].licenses == told[2003].licenses == []
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_spellings(spark):
    same = [("licence licence", "license license"), ("per cent per cent programme", "percent percent program"), ("sub licence", "sublicense"), ("Whilst, whilst!", "while while")]
    rows = [(2 * i + j, t) for i, pair in enumerate(same) for j, t in enumerate(pair)]
    got = {r.doc_id: r.digest for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] == got[2 * i + 1] for i in range(len(same)))


def test_notices_of_documents(spark):
    from tidemark.llm import queries

    where = "/root/testdata/sf0.001"
    notices = {n: t for n, t in licenses.KNOWN.items() if n.startswith("notice-")}
    docs = spark.read.parquet(f"{where}/documents.parquet").collect()
    want = {r.doc_id: ",".join(sorted(n for n, t in notices.items() if t in (r.text or "").split("\n"))) for r in docs}
    assert any(want.values()) and {r.doc_id: r.licenses for r in queries.queries()["op2_license_scan"](spark, where).collect()} == want


def some_vectors(n=400, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.uniform(0.1, 3, (n, 1))
    x[50:80] = x[49] * 1.5 + rng.normal(size=(30, dim)) * 0.05
    rows = [(i, [float(np.float32(c)) for c in v], int(i % 3) if i % 20 else None) for i, v in enumerate(x)]
    return rows + [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [None] * dim, 1), (n + 4, [1.0, 2.0], 1), (n + 5, rows[7][1], rows[7][2])]


def test_top_k(spark):
    rows = some_vectors()
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), k=5).collect()
    ints = {i: np.floor(1024 * np.array(v, float)).astype(int) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in ints:
        if q % 100 == 0:
            best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:5]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want


def test_vectors(spark):
    rows = some_vectors()
    got = {r.vec_id: r for r in vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    ok = {i: (np.array(v, float) / np.linalg.norm(v), g) for i, v, g in rows if g is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    root, links = {i: i for i, _, _ in rows}, dict.fromkeys([r[0] for r in rows], 0)
    for a, b in itertools.combinations(ok, 2):
        (x, g), (y, h) = ok[a], ok[b]
        if g == h and len(x) == len(y) and x @ y >= 0.93:
            links[a] += 1
            links[b] += 1
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if v == old else v for k, v in root.items()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (links[i], root[i], root[i] == i) for i in root}


def test_top_k_edges(spark):
    rows = [(0, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [0.5, 0.0], 1), (None, [9.0, 9.0], 1), (3, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit(0)).withColumn("norm", F.lit(0))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, k=3).collect())
    one = 1 << 20
    assert got == [(0, 1, 1, one), (0, 2, 2, one), (0, 3, 100, one), (100, 1, 0, one), (100, 2, 1, one), (100, 3, 2, one)]
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.where("vec_id = 1")).count() == 0


def test_vectors_edges(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ASKS", 7)
    monkeypatch.setattr(vectors, "CELL", 5)
    rows = [(i, [1.0, i / 1000, 0.0], 1) for i in range(60)] + [(i, [1.0, i / 1000, 0.0], 1) for i in range(5)] + [(None, [1.0, 0.0, 0.0], 1), (900, [1e-30, 0.0, 0.0], 1), (901, [3e30, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("list", F.lit(0)).withColumn("dim", F.lit(0)).withColumn("w", F.lit(0))
    got = vectors.near_duplicate_vectors(df).collect()
    assert len(got) == len(rows) and {(r.n_links, r.component_id) for r in got if r.vec_id is not None} == {(66, 0)}
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0


def test_rounding_closes_gaps(spark):
    # few documents of very different sizes: half a document at most, mostly a few words
    sizes = [40, 60, 80, 100, 120, 150, 160, 180, 190, 250, 310, 360, 370, 390, 420, 450, 490, 530, 820, 1120, 1260, 1500, 2060, 2070, 2120, 2170]
    rows = [(1000 * s + i, "w " * n, f"s{s:02}") for s in range(12) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    miss, most = F.abs(F.sum("taken") - F.first("target")), F.max(F.col("taken") / F.col("size"))
    per = mixing.mix(docs).groupBy("source").agg(miss.alias("miss"), most.alias("most")).collect()
    assert len(per) == 12 and all(r.miss <= max(sizes) / 2 and r.most <= 2 for r in per), per
    assert sorted(r.miss for r in per)[6] <= 20, per


@pytest.mark.parametrize("copies", [3, 40, 219])
def test_equal_rows_change_one_by_one(spark, copies):
    rows = [(1, "w " * 7, "a")] * copies + [(2, "w " * 3, "a")] * 5 + [(3, "w " * 11, "b")] * copies + [(4, "w", "b"), (5, "w " * 997, "c"), (6, "w " * 2, "c"), (6, "w " * 2, "c"), (None, "w " * 2, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit(1)).withColumn("row", F.lit(2)).withColumn("source_size", F.lit("x"))
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id or 0, r["size"], r.source) for r in got) == sorted((i or 0, len(t.split()), s) for i, t, s in rows)
    assert all(r.copies in (0, 1, 2) and r.taken == r.copies * r["size"] for r in got)
    for source in "abc":
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r["size"] for r in mine) / 2
    again = sorted((r.doc_id or 0, r["size"], r.source, r.taken) for r in mixing.mix(docs.repartition(3)).collect())
    assert again == sorted((r.doc_id or 0, r["size"], r.source, r.taken) for r in got)


def test_dual_by_bisection(spark):
    rng = np.random.default_rng(6)
    sizes = {"a": rng.integers(1, 400, 300), "b": rng.integers(5, 20, 80), None: np.array([7] * 10 + [9000])}
    counts = [(s, int(v), int(n)) for s, x in sizes.items() for v, n in zip(*np.unique(x, return_counts=True), strict=True)]
    share = {"a": 0.6, "b": 1.7, None: 1.2}
    wanted = [(s, int(x.sum()), float(share[s] * x.sum())) for s, x in sizes.items()]
    got = mixing.balance(spark.createDataFrame(counts, "source string, size long, n long"), spark.createDataFrame(wanted, "source string, source_size long, target double"), 2.0).collect()
    assert len(got) == 3
    for r in got:
        x = sizes[r.source].astype(float)
        low, high = -60.0, 60.0
        for _ in range(200):
            mid = (low + high) / 2
            taken = (np.minimum(2, np.exp(np.minimum(mid * x / x.mean(), 60))) * x).sum()
            low, high = (mid, high) if taken < share[r.source] * x.sum() else (low, mid)
        assert r.mean == pytest.approx(x.mean()) and r.lam == pytest.approx(low, abs=1e-5)


def test_warc_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CROWD", 4)
    rows = [(i, f"http://a/{i}", "same") for i in range(30)] + [(7, "http://a/7", "same"), (50, "u", "tiny"), (51, "u", "tiny"), (None, "n", "same"), (None, "n", "x" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("header", F.lit(1)).withColumn("payload", F.lit(1))
    warc.write_archive(df, str(tmp_path / "w"))
    got = warc.read_archive(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and spark.read.parquet(str(tmp_path / "w" / "payloads")).count() == 3
    assert sorted((r.record_id or -1, bytes(r.payload).decode()) for r in got) == sorted((i or -1, h) for i, _, h in rows)
    assert sorted((r.record_id, r.record_type, r.refers_to) for r in got if r.record_id in (0, 7, 29, 51)) == sorted([(0, "response", None)] + [(7, "revisit", 0)] * 2 + [(29, "revisit", 0), (51, "revisit", 50)])
    warc.write_archive(df, str(tmp_path / "least"), at_least=5)
    assert {r.record_type for r in warc.read_archive(spark, str(tmp_path / "least")).where("payload_bytes < 5").collect()} == {"response"}
    warc.write_archive(df.limit(0), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0
    damaged = spark.read.parquet(str(tmp_path / "w" / "payloads")).withColumn("payload", F.concat("payload", F.lit(b"!")))
    buckets = spark.read.parquet(str(tmp_path / "w" / "layout")).first().buckets
    damaged.write.bucketBy(buckets, "digest").option("path", str(tmp_path / "bad" / "payloads")).saveAsTable("damaged_payloads")
    for part in ("headers", "layout"):
        spark.read.parquet(str(tmp_path / "w" / part)).write.parquet(str(tmp_path / "bad" / part))
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, str(tmp_path / "bad")).collect()
    spark.sql("DROP TABLE damaged_payloads")


URLS = ["http://a/\u2028X-Source-ID: 99", "http://b/\u0085WARC-Payload-Digest: sha1:ZZ", "c\u2029WARC-Type: revisit", "d\r\nX-Source-ID: 98", "e\nX-Refers-To-Source-ID: 97\r", "f%0A%25", "g%0A\n%", "", None, "h\x0b\x0c\x1c\tX-Source-ID: 96", " spaces ", "é\u2028"]


def test_urls_come_back_exactly(spark, tmp_path):
    rows = [(i, u, "same" if i % 3 else f"own {i}") for i, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    warc.write_archive(df, f"{tmp_path}/w")
    back = warc.read_archive(spark, f"{tmp_path}/w").collect()
    assert {r.record_id: r.target for r in back} == dict(enumerate(URLS)) and len(back) == len(URLS)
    for r in back:
        lines = bytes(r.header).split(b"\r\n")
        assert lines[-1] == b"" and all(b": " in x and b"\n" not in x and b"\r" not in x for x in lines[1:-1])
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op1_warc(spark, str(tmp_path)).collect()}
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = {i: (len(t), digest(t), *(("revisit", 1) if t == "same" and i != 1 else ("response", None))) for i, _, t in rows}
    assert got == want


def test_archive_moves_no_payload_when_read(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(i, "u", "p" * i) for i in range(20)], "page_id long, url string, html string"), str(tmp_path / "w"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        few = warc.read_headers(spark, str(tmp_path / "w")).join(warc.read_payloads(spark, str(tmp_path / "w")), "digest")
        plan = few._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1


def test_staged_tables_of_others_stay(spark):
    from tidemark.llm import common

    other = common.stage(spark.range(3), "other")
    mine: list[str] = []
    with common.noted(mine):
        own = common.stage(spark.range(4), "own")
    assert own.count() == 4 and len(mine) == 1
    common.delete(spark, mine)
    assert not mine and other.count() == 3
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(own.inputFiles()[0]).count()
    common.unstage(other)


def test_urls(spark):
    rows = [(1, "HTTP://WWW.Example.COM/en/712?x"), (2, "https://a.com/en/1"), (3, None), (4, "nohost"), (5, "x://bad.org/a#b"), (6, "x://good.org/es/"), (7, "x://example.net/de/81")]
    pages = spark.createDataFrame(rows + [(100 + i, "x://bad.org/z") for i in range(60)] + [(300 + i, f"x://h{i}.good.org/") for i in range(60)], "page_id long, url string")
    labels = spark.createDataFrame([(100 + i, 1) for i in range(60)] + [(300 + i, 0) for i in range(60)], "id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, labels).collect()}
    assert got[1] == ("www.example.com", "/en/712", "example.com/en/7", "allow") and got[2] == ("a.com", "/en/1", "com/en/", "block")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5] == ("bad.org", "/a", None, "block")
    assert got[6][2:] == ("org/es/", "block") and got[7][2:] == ("example.net/de/8", "block") and got[310][3] == "allow"


def test_the_rules_of_the_url_filter(spark, tmp_path):
    assert urls.RULES == (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
    rows = [(i, "x://bad.net/de/1" if i else "x://a.net/de/1") for i in range(60)] + [(60, "x://example.net/de/7"), (61, "x://example.net/de/8"), (62, "x://bad.net/en/")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, 0, 1) for i in range(1, 60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.page_id: (r.rule, r.verdict) for r in urls.op8_url_filter(spark, str(tmp_path)).collect()}
    assert got[0] == got[1] == got[60] == ("net/de/", "allow") and got[61] == ("example.net/de/8", "block") and got[62] == (None, "block")
    import duckdb

    for name in ("pages", "labels"):
        duckdb.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert {r[0]: (r[3], r[4]) for r in duckdb.sql(urls.op8_sql()).fetchall()} == got


def posteriors(rows, outcomes):
    """host -> (posterior mean, pages) with the chain of priors, in plain Python over the same definition."""
    groups = {}
    for host, bad in outcomes:
        domain, suffix = ".".join(host.split(".")[-2:]), host.split(".")[-1]
        for key in (("s", suffix), ("d", domain), ("h", host)):
            n, b = groups.get(key, (0, 0))
            groups[key] = (n + 1, b + bad)
    up = {"h": lambda g: ("d", ".".join(g.split(".")[-2:])), "d": lambda g: ("s", g.split(".")[-1])}
    top = (sum(b for _, b in outcomes) + 1) / (len(outcomes) + 2)
    mean, weight = {}, {}
    for kind in "sdh":
        own = {g: v for (k, g), v in groups.items() if k == kind}
        prior = {g: top if kind == "s" else mean[up[kind](g)] for g in own}
        many = [(own[g][0], own[g][1], prior[g]) for g in own if own[g][0] > 1]
        a, b, c = (sum(f(n, x, p) for n, x, p in many) for f in (lambda n, x, p: p * (1 - p), lambda n, x, p: n * (x / n - p) ** 2, lambda n, x, p: p * (1 - p) * (n - 1)))
        weight[kind] = urls.MOST_PRIOR if not c else max(urls.LEAST_PRIOR, min(urls.MOST_PRIOR, 1 / max(1e-9, min(1.0, (b - a) / c)) - 1))
        mean |= {(kind, g): (weight[kind] * prior[g] + x) / (weight[kind] + n) for g, (n, x) in own.items()}
    out = {}
    for host in rows:
        d, s = ("d", ".".join(host.split(".")[-2:])), ("s", host.split(".")[-1])
        n, x = groups.get(("h", host), (0, 0))
        w, p = (weight["h"], mean[d]) if d in mean else (weight["d"], mean[s]) if s in mean else (weight["s"], top)
        out[host] = ((w * p + x) / (w + n), w + n)
    return out


def test_reputations_are_the_chain_of_priors(spark):
    rng = random.Random(3)
    hosts = [f"h{i}.{d}{s}" for s in (".org", ".com", ".edu") for d in ("a", "b", "c") for i in range(6)]
    rate = {h: rng.random() ** 2 for h in hosts}
    pages = [(i, f"http://{rng.choice(hosts)}/x") for i in range(900)] + [(5000, "http://new.a.org/"), (5001, "http://x.new.org/"), (5002, "http://x.y.new/"), (5003, "http:///"), (5004, None), (0, "http://h0.a.org/again")]
    of = lambda u: u.split("/")[2]
    labels = [(i, int(rng.random() < rate[of(u)])) for i, u in pages[:600]] + [(3, None), (99999, 1), (5, 1)]
    known = dict(labels[:600])
    outcomes = [(of(u), known[i]) for i, u in pages if u and of(u) and i in known] + [(of(pages[5][1]), 1)]
    want = posteriors({of(u) for _, u in pages if u and of(u)}, outcomes)
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("suffix", F.lit(1)).withColumn("n", F.lit(1))
    got = urls.filter_urls(df, spark.createDataFrame(labels, "id long, bad int"), rules=()).collect()
    assert len(got) == len(pages)
    for r in got:
        if r.host:
            m, n = want[r.host]
            assert r.reputation == pytest.approx(m - urls.SIGMAS * math.sqrt(m * (1 - m) / (n + 1)), abs=1e-7)
            assert r.verdict == ("block" if r.reputation > 0.5 else "allow")
        else:
            assert r.reputation is None and r.verdict == "allow"
    assert {r.verdict for r in got} == {"allow", "block"}
    none = spark.createDataFrame([], "id long, bad int")
    assert {r.verdict for r in urls.filter_urls(df, none, rules=()).collect()} == {"allow"} and urls.filter_urls(df.limit(0), none).count() == 0


def test_very_long_texts(spark):
    """A text longer than one pass over it, with a passage across the border of passes, and a copy of its end."""
    rng = random.Random(12)
    long = "".join(rng.choice("abcdefghijklmnop ") for _ in range(suffixes.SPAN + 5000))
    across = long[suffixes.SPAN - 300 : suffixes.SPAN + 300]
    rows = [(1, long), (2, "xyz " * 5 + across + " zyx"), (3, long[-4000:] + "!")]
    got = {r.doc_id: tuple(r)[1:5] for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {2: rows[1][1].replace(across, "", 1), 3: "!"}
    assert got[1][1:3] == (0, 0) and got[2][1] >= 600 and got[3][1] == 4000
    assert got[3][3] == hashlib.sha256(want[3].encode()).hexdigest()
    sets = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame([(1, long), (2, long + " tail"), (3, "other words of no kin at all")], "doc_id long, text string")).collect()}
    assert (sets[2].component_id, sets[3].component_id) == (1, 3) and sets[1].n_shingles == len(shingle_set(long))
    told = licenses.scan_licenses(spark.createDataFrame([(1, long + "\n" + licenses.KNOWN["notice-MIT"] + "\n" + long)], "doc_id long, text string")).first()
    assert told.licenses == ["notice-MIT"]


@pytest.fixture(scope="module")
def stage_docs():
    """Texts of two languages with nulls, copies, near copies, shared passages, junk and rows that share an id or have none."""
    rng = random.Random(9)
    parts = {"en": ["the", "ing", "and", "th", "ower", "ish"], "de": ["der", "sch", "und", "ung", "lich", "keit"]}
    word = lambda g: "".join(rng.choice(parts[g]) for _ in range(rng.randrange(1, 4)))
    rows = [[i, " ".join(word(g) for _ in range(rng.randrange(20, 200))), g, f"s{i % 3}" if i % 7 else None, 0] for i, g in enumerate(["en", "de"] * 40)]
    passage = " ".join(word("en") for _ in range(60))
    for i in (4, 10, 20):
        rows[i][1] += " " + passage + " é"
    rows[31][1], rows[33][1] = rows[3][1], rows[5][1] + " tail"
    rows[6][2] = rows[8][2] = None
    rows += [[100, None, "en", "s1", 0], [101, "", "de", "s1", 0], [102, "12 !? 34", "en", "s0", 0], [None, rows[40][1], "en", "s0", 0], [None, rows[41][1], "de", None, 0], [50, "zz " + rows[50][1], "en", "s9", 1], [60, rows[60][1], "en", "s2", 0]]
    return [(i, t, g, s, len(t or "")) for i, t, g, s, _ in rows]


def run_stage(spark, step, rows):
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("extra")).withColumn("size", F.lit(1))
    out = step(spark, df, "/nowhere")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_stage_language(spark, stage_docs):
    import corpus_pipeline as p

    true = {i: ["en", "de"][i % 2] for i in range(80)}
    want = [(i, t, g or true[i], s, n) for i, t, g, s, n in stage_docs if t and re.search("[a-z]", t)]
    assert run_stage(spark, p.keep_identified, stage_docs) == sorted(want, key=repr)
    assert run_stage(spark, p.keep_identified, stage_docs[:0] or []) == []


def test_stage_near_copies(spark, stage_docs):
    import corpus_pipeline as p

    first = {}
    for r in stage_docs:
        if r[0] is not None:
            first[r[0]] = min(first.get(r[0], r), r, key=lambda x: (x[1] is None, x[1] or "", x[2] or "", x[3] or ""))
    sets = {i: shingle_set(r[1]) for i, r in first.items()}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if v == old else v for k, v in root.items()}
    want = [r for i, r in first.items() if root[i] == i] + [r for r in stage_docs if r[0] is None]
    assert {31, 33} & set(root) and root[31] == 3 and root[33] == 5
    assert run_stage(spark, p.keep_one_of_near_copies, stage_docs) == sorted(want, key=repr)
    assert run_stage(spark, p.keep_one_of_near_copies, []) == []


def test_stage_repeated_passages(spark, stage_docs):
    import corpus_pipeline as p

    docs = [r for r in stage_docs if r[0] is not None and r[4] + r[0] != 51]
    docs = [r for i, r in enumerate(docs) if r[0] not in [x[0] for x in docs[:i]]]
    seen, want = set(), [r for r in stage_docs if r[0] is None]
    for i, t, g, s, _ in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for at in range(len(b) - 99):
            if b[at : at + 100] in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(b[at : at + 100])
        at, kept = 0, ""
        for c in t or "":
            n = len(c.encode())
            kept += "" if all(gone[at : at + n]) else c
            at += n
        want.append((i, kept, g, s, len(kept)))
    got = run_stage(spark, p.cut_repeated_passages, docs + [r for r in stage_docs if r[0] is None])
    assert got == sorted(want, key=repr) and sum(r[4] for r in got) < sum(r[4] for r in stage_docs)
    assert run_stage(spark, p.cut_repeated_passages, []) == []


def test_stage_mixture(spark, stage_docs):
    import corpus_pipeline as p

    rows = stage_docs + [stage_docs[12], (None, stage_docs[40][1], "en", "s0", 0)]
    got = run_stage(spark, p.mix_sources, rows)
    times = Counter(got)
    held = Counter(tuple(r) for r in rows)
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    assert set(times) <= set(held) and all(n <= 2 * held[r] and words(r) for r, n in times.items())
    goal = {r.source: r.target for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()}
    taken = Counter()
    for r, n in times.items():
        taken[r[3]] += n * words(r)
    assert all(abs(taken[s] - t) <= max(words(r) for r in rows if r[3] == s) for s, t in goal.items())
    assert run_stage(spark, p.mix_sources, []) == []


def test_stage_tokens(spark, stage_docs):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_path())
    df = spark.createDataFrame(stage_docs, DOCS).withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    got = sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in p.encode(spark, df, "/nowhere").collect())
    assert got == sorted((r[0] or -1, library.encode(r[1] or "", add_special_tokens=False).ids) for r in stage_docs)
    assert p.encode(spark, df.limit(0), "/nowhere").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = docs.columns
    for i, (name, step) in enumerate(p.STAGES):
        before = docs.count()
        step(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if name == "tokens":
            assert docs.count() == before
        else:
            assert docs.columns == names and docs.count() > 0


def test_language_fit_spread_equals_fit(spark):
    """The rounds over the cluster give what the rounds in memory give."""
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b" a", b"cb"]
    counts = {"x": {"abc": 3, "ab" * 20: 1, "é": 2}, "y": {"cba": 2, "abc": 1}, "z": {"ü": 7}}
    rows = [(g, w, n) for g, c in counts.items() for w, n in c.items()]
    spread = language.fit_spread(spark.createDataFrame(rows, "lang string, word string, n long"), pieces, smoothing=2.0)
    local = language.fit(counts, pieces, smoothing=2.0)
    assert spread.languages == local.languages and spread.weights[0:3] == pytest.approx(local.weights, rel=1e-9)
    assert language.fit_spread(spark.createDataFrame([], "lang string, word string, n long"), pieces) is None


def test_language_many_labels(spark, monkeypatch):
    """300 labels are all learned, in tables of 64; scores that don't fit together are summed up in turn."""
    rng = random.Random(5)
    syllables = {g: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(4)] for g in range(300)}
    rows = [(i, " ".join("".join(rng.choice(syllables[i % 300]) for _ in range(2)) for _ in range(20)), f"l{i % 300:03}") for i in range(1800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    key = lambda df: {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in df.collect()}
    got = key(language.identify(df, language.vocabulary_path()))
    held = [i for i, r in got.items() if r[0]]
    assert len({r[1] for r in got.values()}) == 300 and sum(got[i][1] == rows[i][2] for i in held) >= 0.95 * len(held)
    few = df.where("doc_id % 300 < 70")
    whole = key(language.identify(few, language.vocabulary_path()))
    monkeypatch.setattr(language, "CACHED_SCORES", 70 * 7)
    sliced = key(language.identify(few, language.vocabulary_path()))
    assert all(sliced[i][:2] == r[:2] and sliced[i][2] == pytest.approx(r[2], rel=1e-9) for i, r in whole.items())
