"""The streaming reducer on its state store: stopped and started again between any two batches, late and idle groups."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import inputs

from tidemark.operators import reducer
from tidemark.streaming.segments import stream_segments


def scenario(seed):
    rng = random.Random(seed)
    rows, kinds = [], [("SONG", 1, "a", None, None), ("SONG", None, None, None, None), ("SONG", 2, "b", None, None), ("COMMERCIAL", None, None, "Shop", "buy our tires at the shop"), ("COMMERCIAL", None, None, None, "our tires at the shop today"), ("DJ", None, None, None, "hello there"), (None, None, None, None, None)]
    kind = kinds[0]
    for i in range(60):
        kind = rng.choice(kinds) if rng.random() < 0.4 else kind
        rows.append((10 * i, *kind))
    return rows


@pytest.mark.parametrize("restart", [False, True])
def test_batches_with_stops_are_the_batch(spark, tmp_path, restart):
    want, frames = set(), []
    for g in range(3):
        w = inputs(spark, scenario(g)).withColumn("g", F.lit(g))
        frames.append(w)
        want |= {(r.g, r.category, r.timestamp_start, r.timestamp_end, r.song_id, r.track_title, r.brand_name, r.transcript_excerpt) for r in reducer.reduce_segments(w, ["g"], "ts").collect()}
    whole = frames[0].union(frames[1]).union(frames[2])
    rows = whole.collect()
    rng = random.Random(1)
    order = sorted(range(len(rows)), key=lambda i: (rows[i].ts.timestamp() + rng.uniform(-25, 25)))  # a little out of order
    end = inputs(spark, [(90_000, "DJ", None, None, None, "x")]).withColumn("g", F.lit(9))
    parts = [spark.createDataFrame([rows[i] for i in order[k * 30 : (k + 1) * 30]], whole.schema) for k in range(6)]
    source, sink, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    live = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    made = lambda: stream_segments(live, ["g"], "ts").writeStream.format("parquet").option("path", sink).option("checkpointLocation", cp)
    for k, part in enumerate([*parts, end, end.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))]):
        part.coalesce(1).write.parquet(f"{source}/{k}")
        if restart:
            q = made().trigger(availableNow=True).start()
            q.awaitTermination()
    if not restart:
        q = made().start()
        q.processAllAvailable()
        q.stop()
    got = [(r.g, r.category, r.timestamp_start, r.timestamp_end, r.song_id, r.track_title, r.brand_name, r.transcript_excerpt) for r in spark.read.parquet(sink).where("g < 9").collect()]
    assert set(got) == want and len(got) == len(want) > 20
