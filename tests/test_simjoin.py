"""Similarity joins and the resolution of commercials against plain walks over all pairs."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import event, make

from tidemark.operators import funnel, repair, resolve, simjoin, speech


def words_of(text):
    return [w.lower() for w in re.findall("[A-Za-z0-9']+", text or "")]


def similarity(x, y):
    a, b = Counter(words_of(x)), Counter(words_of(y))
    if not a or not b:
        return 0.0
    jaccard = len(a & b) / len(a | b)
    return max(jaccard, sum(n * b[w] for w, n in a.items()) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())))


def texts(n, seed, vocabulary=300, most=40):
    rng = random.Random(seed)
    vocabulary = [f"w{int(x)}" for x in rng.sample(range(10_000), vocabulary)]
    out = []
    for i in range(n):
        if i and rng.random() < 0.5:
            t = list(rng.choice(out).split())
            for _ in range(rng.randrange(0, 1 + len(t) // 3)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
        else:
            t = [vocabulary[int(rng.random() ** 3 * len(vocabulary))] for _ in range(rng.randrange(1, most))]
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("least", [0.3, 0.55, 0.8, 1.0])
def test_similar_pairs(spark, least):
    rows = [(i, i % 3 if i % 11 else None, t) for i, t in enumerate(texts(240, 5))]
    rows += [(900, 1, None), (901, 1, ""), (902, 1, "!?"), (903, 2, "One two"), (904, 2, "one TWO"), (905, 2, "two one"), (906, 0, "the " * 400), (907, 0, "the " * 3 + "end"), (None, 1, "one two")]
    want = {}
    for (a, p, x), (b, q, y) in itertools.combinations([r for r in rows if r[0] is not None], 2):
        if p is not None and p == q and (s := similarity(x, y)) >= least - 1e-12:
            want[a, b] = s
    df = spark.createDataFrame(rows, "id long, k int, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(2)).repartition(4)
    got = {(r.a, r.b): r.similarity for r in simjoin.similar_pairs(df, ["k"], "id", "text", least).collect()}
    for k in [k for k, s in want.items() if abs(s - least) < 1e-12 and k not in got]:
        del want[k]  # the last bit of a root decides
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 3
    links = {(r.a, r.b) for r in simjoin.similar_links(df, ["k"], "id", "text", least).collect()}
    assert len(links) <= len(want)
    groups = lambda pairs: {frozenset(g) for g in connected(pairs)}
    assert groups(links) == groups(want) and simjoin.similar_pairs(df.limit(0), ["k"], "id", "text", least).count() == 0


def test_copies_cost_a_row_each(spark, tmp_path):
    """The query tells copies by their first ad and loses no pair of different texts."""
    from tidemark.plans import queries

    import duckdb

    n = 600
    part = spark.range(n).select(F.col("id").alias("p_partkey"), F.concat(F.lit("part "), (F.col("id") / 100 % 3).cast("int").cast("string")).alias("p_name"), F.lit("T").alias("p_type"), F.concat(F.lit("Brand#"), (F.col("id") % 2).cast("string")).alias("p_brand"), F.lit(7).alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    for name in ("events", "supplier", "nation", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    got = {(r.a, r.b): r.similarity for r in queries.similar_pairs(spark, str(tmp_path)).collect()}
    text = {r.p_partkey: f"{r.p_name} {r.p_type} {r.p_brand}" for r in part.collect()}
    firsts = {(t, i % 10): min(j for j in text if text[j] == t and j % 10 == i % 10) for i, t in text.items()}
    first = {i: firsts[t, i % 10] for i, t in text.items()}
    want = {(first[i], i) for i in text if first[i] != i}
    want |= {(a, b) for a in firsts.values() for b in firsts.values() if a < b and a % 10 == b % 10 and similarity(text[a], text[b]) >= 0.55}
    assert got.keys() == want and len(got) < 2 * n
    for name in ("part", "events", "supplier", "nation", "lineitem"):
        duckdb.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert {(r[0], r[1]): float(r[2]) for r in duckdb.sql(queries.ORACLES["similar_pairs"]).fetchall()} == got


def test_query_gives_every_pair_of_copies(spark, tmp_path):
    """Copies pair with each other and with all that their text is alike to, in the query as in its SQL."""
    from tidemark.plans import queries

    import duckdb

    said = ["red ring", "red ring", "red nut", "old bolt", "red ring", "ring red red"]
    part = spark.createDataFrame([(10 * i, said[i % 6], "T", "Brand#1", 7, 1.0) for i in range(30)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double")
    for name in ("events", "supplier", "nation", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(5).write.parquet(str(tmp_path / f"{name}.parquet"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    got = {(r.a, r.b): r.similarity for r in queries.similar_pairs(spark, str(tmp_path)).collect()}
    text = {r.p_partkey: f"{r.p_name} {r.p_type} {r.p_brand}" for r in part.collect()}
    assert got.keys() == {(a, b) for a, b in itertools.combinations(sorted(text), 2) if similarity(text[a], text[b]) >= 0.55}
    assert {(0, 10), (10, 40), (10, 20), (20, 40)} <= got.keys()
    for name in ("part", "events", "supplier", "nation", "lineitem"):
        duckdb.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert {(r[0], r[1]): float(r[2]) for r in duckdb.sql(queries.ORACLES["similar_pairs"]).fetchall()} == got


@pytest.mark.parametrize("least", [0.3, 0.55, 0.8, 1.0])
def test_similar_pairs_dealt_out_in_parts(spark, monkeypatch, least):
    """Pairs come once each where words of short texts are dealt out in many parts, beside longer texts; links leave none out."""
    monkeypatch.setattr(simjoin, "PART", 7)
    rng = random.Random(11)
    said = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice((1, 2, 3, 5, 5, 6, 9)))) for _ in range(220)] + texts(60, 3, 60, 30)
    rows = [(3 * i, i % 2 + 0.5, t) for i, t in enumerate(said)]
    df = spark.createDataFrame(rows, "id long, k double, text string").repartition(5)
    found = simjoin.similar_links(df, ["k"], "id", "text", least).collect()
    got = {(r.a, r.b): r.similarity for r in found}
    want = {(a, b): s for (a, p, x), (b, q, y) in itertools.combinations(rows, 2) if p == q and (s := similarity(x, y)) >= least - 1e-12}
    for k in [k for k, s in want.items() if abs(s - least) < 1e-12 and k not in got]:
        del want[k]  # the last bit of a root decides
    assert len(found) == len(got) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_pairs_of_short_texts_are_not_shuffled(spark):
    """A block of alike texts: pairs leave the tasks that decide them, so disk doesn't grow with pairs."""
    df = spark.range(2_000).select("id", F.lit(1).alias("k"), F.concat(F.lit("a b c "), F.col("id") % 500).alias("text"))
    pairs = simjoin.similar_pairs(df, ["k"], "id", "text", 0.55)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") and pairs.count() == 2_000 * 1_999 // 2


def connected(pairs):
    of = {}
    for a, b in pairs:
        g = of.get(a, {a}) | of.get(b, {b})
        for x in g:
            of[x] = g
    return list(of.values())


def test_rounds_of_components_keep_their_size(spark):
    """What the driver thinks a round's table holds doesn't multiply with the rounds."""
    path = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long")
    got = resolve.components(path)
    assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(13)}
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 40


def test_pairs_of_a_large_block(spark):
    """A hundred thousand texts in one block: candidates are near the pairs that are alike, not all five billion."""
    n = 100_000
    df = spark.range(n).select("id", F.lit(1).alias("k"), F.concat_ws(" ", *[F.concat(F.lit(f"{c}x"), F.pmod(F.xxhash64(F.col("id") - F.col("id") % 2, F.lit(c)), F.lit(30_000))) for c in range(8)], F.concat(F.lit("own"), F.col("id")), F.lit("and the")).alias("text"))
    index = simjoin.prefixes(df.select("k", "id", F.split("text", " ").alias("words")), ["k"], "id", "words", 0.55, 0.55)
    met = simjoin.candidates(index, index, ["k"], 0.55, 0.55).count()
    got = simjoin.similar_pairs(df, ["k"], "id", "text", 0.55)
    assert got.where("b - a = 1 and a % 2 = 0").count() == n // 2 and met < 4 * n


def fold(rows, known=(), primary=0.70, secondary=0.55, cosine=0.85):
    """(seq, brand, text, seconds) in order, each against all ads so far."""
    p, q = resolve._coefficients(resolve.PERMUTATIONS)
    ads, want = {}, {}

    def told(brand, text):
        words = words_of(text)
        features = {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else set(words)
        heads = [int.from_bytes(hashlib.sha1(f.encode()).digest()[:4], "little") for f in features | {f"__brand__:{brand.lower()}"}]
        return [min((int(x) * h + int(y)) % ((1 << 61) - 1) & 0xFFFFFFFF for h in heads) for x, y in zip(p, q, strict=True)], Counter(words)

    for name, brand, bucket, text in known:
        ads.setdefault((brand, bucket), []).append((name, *told(brand, text)))
    for seq, brand, text, seconds in sorted(rows):
        key = (brand, int(round(seconds / 5) * 5))
        mine, bag = told(brand, text)

        def alike(theirs, other, mine=mine, bag=bag):
            share = sum(x == y for x, y in zip(mine, theirs, strict=True)) / len(mine)
            norm = math.sqrt(max(1.0, float(sum(v * v for v in bag.values())) * float(sum(v * v for v in other.values()))))
            angle = sum(n * other[t] for t, n in bag.items()) / norm
            return share >= primary or (cosine > 0 and angle >= cosine) or (share >= secondary and angle >= 0.85)

        match = next((name for name, theirs, other in ads.setdefault(key, []) if alike(theirs, other)), None)
        if match is None:
            ads[key].append((seq, mine, bag))
        want[seq] = ("inserted", seq) if match is None else ("matched", match)
    return want


@pytest.mark.parametrize("first, options", [(4_096, {}), (7, {}), (7, {"cosine": 0.0}), (20, {"primary": 0.9, "cosine": 0.95}), (7, {"primary": 0.5, "cosine": 0.6})])
def test_resolution_is_the_fold(spark, monkeypatch, first, options):
    monkeypatch.setattr(resolve, "FIRST", first)
    rows = [(3 * i, ("Acme", "Zoom Co")[i % 3 == 0], t, (20.0, 31.0)[i % 5 == 0]) for i, t in enumerate(texts(220, 11))]
    rows += [(5000 + i, "Acme", rows[i][2] + " more", 20.0) for i in range(0, 40, 3)] + [(6000, "Acme", "", 20.0), (6001, "Acme", None, 20.0), (6002, "Acme", "one", 20.0)]
    df = spark.createDataFrame(rows, "seq long, brand string, transcript string, duration_seconds double").withColumn("key_phrases", F.array().cast("array<string>")).withColumn("id", F.lit(0)).repartition(4)
    got = {r.seq: (r.outcome, r.ad) for r in resolve.resolve_commercials(df, **options).collect()}
    want = fold(rows, **options)
    assert got == want and {o for o, _ in want.values()} == {"inserted", "matched"}


def test_known_ads_come_first(spark, monkeypatch):
    monkeypatch.setattr(resolve, "FIRST", 9)
    made = texts(120, 13)
    older = spark.createDataFrame([(i, "Acme", t, 20.0) for i, t in enumerate(made[:30])], "seq long, brand string, transcript string, duration_seconds double").withColumn("key_phrases", F.array().cast("array<string>"))
    told = {r.seq: r.minhash_hex for r in resolve.resolve_commercials(older).collect()}
    known = [(i + 50, "Acme", 20, made[i]) for i in reversed(range(30))]
    rows = [(i, "Acme", t, 20.0) for i, t in enumerate(made)]
    df = spark.createDataFrame(rows, "seq long, brand string, transcript string, duration_seconds double").withColumn("key_phrases", F.array().cast("array<string>"))
    ads = spark.createDataFrame([(name, brand, bucket, told[name - 50], text) for name, brand, bucket, text in known], "ad long, brand string, bucket int, minhash_hex string, transcript string")
    got = {r.seq: (r.outcome, r.ad) for r in resolve.resolve_commercials(df, ads).collect()}
    assert got == fold(rows, sorted(known)) and all(len(h) == 2048 for h in told.values())


def test_chosen_first(spark):
    rng = random.Random(2)
    for links in ([(i, i + 1) for i in range(30)], [(0, i) for i in range(1, 40)], [tuple(sorted(rng.sample(range(60), 2))) for _ in range(120)], []):
        taken = []
        for i in range(60):
            if not any((j, i) in links for j in taken):
                taken.append(i)
        got = resolve.chosen_first(spark.range(60), spark.createDataFrame(links, "a long, b long").distinct())
        assert sorted(r.id for r in got.collect()) == taken


def test_dedupe_across_brands_and_copies(spark):
    said = ["save on tires today at the shop", "save on tires today at our shop", "totally different words here friend"]
    ads = [{"id": 10 * k + i, "brand_id": k, "duration_bucket_seconds": 20, "reference_transcript": said[i % 3]} for k in (1, 2) for i in range(9)]
    t = make(spark, brands=[{"id": 1, "canonical_name": "Shop", "aliases": []}, {"id": 2, "canonical_name": "Store", "aliases": []}], commercials=ads, events=[event(1, 0, 20, "COMMERCIAL", commercial_id=14), event(2, 90, 20, "COMMERCIAL", commercial_id=22)])
    got = {(r.loser_id, r.survivor_id) for r in repair.plan_commercial_dedupe(t).collect()}
    keep = {(1, True): 14, (1, False): 12, (2, True): 20, (2, False): 22}
    assert got == {(a["id"], s) for a in ads if (s := keep[a["brand_id"], a["id"] % 10 % 3 != 2]) != a["id"]}


def counted(spark, columns, make_row):
    """A model that counts the rows it is given, and the count."""
    calls = spark.sparkContext.accumulator(0)

    def model(df):
        def run(frames):
            for f in frames:
                calls.add(len(f))
                yield make_row(f)

        return df.mapInPandas(run, columns)

    return model, calls


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_models_are_called_once_for_each_window(spark, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        loud = np.full(100, 2000, "<i2").tobytes()
        df = spark.createDataFrame([(i, loud) for i in range(10)], "w long, pcm binary")
        hear, heard = counted(spark, "w long, transcript string", lambda f: f.assign(transcript="four whole words here")[["w", "transcript"]])
        judge, judged = counted(spark, "w long, answer_json string", lambda f: f.assign(answer_json='{"class": "DJ", "confidence": 0.5}')[["w", "answer_json"]])
        assert {r.sp.status for r in speech.speech_tier(df, "w", hear, judge).collect()} == {"ok"} and (heard.value, judged.value) == (10, 10)
        windows = spark.range(12).select(F.lit("s").alias("s"), F.col("id").alias("w"), F.struct(F.lit("no_match").alias("status"), F.lit(None).cast("string").alias("track_id"), F.lit("a").alias("artist"), F.lit("t").alias("title"), F.lit(0.0).alias("match_score")).alias("fp"), F.struct(F.when(F.col("id") < 8, "MUSIC").otherwise("SPEECH").alias("label"), F.lit(0.5).alias("music_prob"), F.lit(0.05).alias("speech_prob")).alias("ac"))
        ask, asked = counted(spark, "w long, sz struct<status: string, artist: string, title: string, confidence: double>", lambda f: f[["w"]].assign(sz=[{"status": "match", "artist": "x", "title": "y", "confidence": 0.5}] * len(f)))
        speak, spoke = counted(spark, "w long, sp struct<status: string, category: string, brand: string, transcript: string, confidence: double>", lambda f: f[["w"]].assign(sp=[{"status": "ok", "category": "DJ", "brand": None, "transcript": "t", "confidence": 0.5}] * len(f)))
        out = funnel.run_funnel(windows, ["s"], ["w"], "w", ask, speak)
        out.collect()
        assert Counter(r.stage for r in out.collect()) == {"shazam_fallback": 8, "tier3_speech": 4} and (asked.value, spoke.value) == (2, 4)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_window_leaves_its_first_ad_only(spark):
    """Of ads and windows that are all alike, no pairs but one a window leave the tasks where blocks meet."""
    rows = [(i, "Acme", 20, "the and of to in " * 20 + f"own{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, brand string, bucket int, words string")
    df = df.select("id", "brand", "bucket", simjoin.packed(F.col("words")).alias("p"), resolve.signed(F.array("brand"), F.col("words")).alias("sig")).select("id", "brand", "bucket", "p.bag", "p.mass", "sig")
    ads, later = (resolve._Index(df.where(where), primary=0.7, secondary=0.55, cosine=0.85) for where in ("id < 200", "id >= 200"))
    assert sorted((r.a, r.b) for r in ads.first_of(later).collect()) == [(0, i) for i in range(200, 400)]
    assert ads.links().count() == 200 * 199 // 2


def test_signatures_of_all_texts_at_once():
    p, q = resolve._coefficients(resolve.PERMUTATIONS)
    said = ["", "one", "two words", "a b c d a b c", "x" * 30 + " " + "y" * 30 + " short " + "z" * 80, "", *texts(40, 5)]
    said = [" ".join(words_of(t)) for t in said]
    marks = [["__brand__:é", "phrase two"] if i % 2 else ["__brand__:a"] for i in range(len(said))]
    for text, mine, got in zip(said, marks, resolve.signatures(marks, said), strict=True):
        words = text.split()
        features = {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else set(words)
        heads = [int.from_bytes(hashlib.sha1(f.encode()).digest()[:4], "little") for f in features | set(mine)]
        assert [min((int(x) * h + int(y)) % ((1 << 61) - 1) & 0xFFFFFFFF for h in heads) for x, y in zip(p, q, strict=True)] == got.tolist()


@pytest.mark.parametrize("least", [0.3, 0.55, 0.8, 1.0])
def test_spanning_links_have_the_components_of_all_pairs(spark, least):
    rng = random.Random(7)
    said = [" ".join(rng.choice("abcdefghij") for _ in range(rng.choice((1, 2, 3, 4, 5, 5, 6, 8)))) for _ in range(160)] + texts(40, 3, 60, 12) + ["", None, "a A b", "b a a", "a a a a", "a a b b c c"]
    rows = [(3 * i, (i % 4 if i % 13 else None), t) for i, t in enumerate(said)]
    df = spark.createDataFrame(rows, "id long, k int, text string")
    got = [(r.a, r.b) for r in simjoin.spanning_links(df, ["k"], "id", "text", least).collect()]
    want = [(a, b) for (a, p, x), (b, q, y) in itertools.combinations(rows, 2) if p is not None and p == q and similarity(x, y) >= least - 1e-12]
    assert {frozenset(g) for g in connected(got)} == {frozenset(g) for g in connected(want)} and want


def test_spanning_links_of_a_large_block(spark):
    """Three thousand short texts in one block, 4.5 million pairs, of which over 200,000 are alike: a few links a text are enough."""
    n = 3_000
    word = lambda c, of: F.concat(F.lit(f"{c}x"), F.pmod(F.xxhash64("id", F.lit(c)), F.lit(of)))
    df = spark.range(n).select("id", F.lit(1).alias("k"), F.concat_ws(" ", word(1, 8), word(2, 8), word(3, 6), F.lit("brand"), word(4, 25)).alias("text"))
    links = simjoin.spanning_links(df, ["k"], "id", "text", 0.55).collect()
    groups = {frozenset(g) for g in connected([(r.a, r.b) for r in links])}
    assert [len(g) for g in groups] == [n] and len(links) < 12 * n
