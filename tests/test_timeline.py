"""Timelines against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from siftwork.operators import timeline as L


def far(x, others, gap):
    return all(abs(x - y) >= gap for y in others)


def test_thin_matches_loop(spark):
    rng = random.Random(1)
    rows = [(s, round(rng.random() * 20, 3)) for s in range(5) for _ in range(60)] + [(9, 0.0), (9, 0.35), (9, 0.7), (9, 0.9)]
    df = spark.createDataFrame(rows, "s int, t double")
    for most in (None, 7):
        got = {}
        for r in L.thin(df, "s", "t", 0.35, most).orderBy("s", "sequence").collect():
            got.setdefault(r.s, []).append(r.t)
        for s in {r[0] for r in rows}:
            last, want = -1000.0, []
            for t in sorted(t for q, t in rows if q == s):
                if t > 0 and t - last >= 0.35 and len(want) < (most or 999):
                    want.append(t)
                    last = t
            assert got.get(s, []) == want


def test_uniform_fill_matches_loop(spark):
    rng = random.Random(2)
    spans = [(s, d, n) for s, (d, n) in enumerate([(10.0, 18), (100.0, 30), (1000.0, 75), (0.0, 3), (50.0, 4)])]
    accepted = [(s, round(rng.random() * d, 2)) for s, d, n in spans for _ in range(n // 4)]
    got = {}
    df = L.uniform_fill(spark.createDataFrame(spans, "s int, duration double, target int"), spark.createDataFrame(accepted, "s int, t double"), "s")
    for r in df.orderBy("s", "sequence").collect():
        got.setdefault(r.s, []).append(r.t)
    for s, d, n in spans:
        have = [t for q, t in accepted if q == s]
        need = max(1, n - len(have))
        margin = min(0.5, d * 0.08)
        end = max(margin, d - margin)
        want = []
        for i in range(2 * need):
            x = margin + (end - margin) / (2 * need + 1) * (i + 1)
            if len(want) < need and far(x, have + want, 0.5):
                want.append(x)
        assert got.get(s, []) == pytest.approx(want)


def test_threshold_stops_at_first_fit(spark):
    scores = [(1, i, x) for i, x in enumerate([0.5] * 3 + [0.3] * 8 + [0.22] * 9)] + [(2, 0, 0.9)]
    df = spark.createDataFrame(scores, "s int, i int, score double")
    targets = spark.createDataFrame([(1, 18), (2, 18), (3, 18)], "s int, target int")
    got = {r.s: (r.threshold, r.scenes, r.wanted) for r in L.adaptive_threshold(df, targets, "s").collect()}
    assert got == {1: (0.26, 11, 11), 2: (0.32, 1, 11), 3: (0.32, 0, 11)}


def test_nearest_moment(spark):
    rows = [(1, 1.0, "a"), (1, 3.0, "b"), (1, 10.0, "c")]
    want = [(1, 0.0, "a"), (1, 2.0, "a"), (1, 2.1, "b"), (1, 6.5, "b"), (1, 6.6, "c"), (1, 99.0, "c")]
    got = L.nearest_moment(spark.createDataFrame([w[:2] for w in want], "s int, t double"), spark.createDataFrame(rows, "s int, at double, n string"), "s", "at", ["n"])
    assert sorted((r.s, r.t, r.row.n) for r in got.collect()) == want


def test_guard_and_ids(spark):
    df = spark.createDataFrame([("VID-0001", 5, "b", "kept"), ("VID-0001", 1, "a", "filtered")], "v string, t int, n string, status string")
    assert [r.frame_id for r in L.frame_ids(df, "v", "t", "n").orderBy("t").collect()] == ["FRM-VID-0001-0001", "FRM-VID-0001-0002"]
    assert [(r.v, r.kept) for r in L.kept_guard(df, "v").collect()] == [("VID-0001", 1)]


def test_streaming_thinning(spark, tmp_path):
    from siftwork.streaming.thinning import thin_stream

    src = str(tmp_path / "in")
    rows = [(1, x) for x in (0.1, 0.3, 0.6, 2.0, 2.2)] + [(2, 5.0)]
    spark.createDataFrame(rows, "s int, t double").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("s int, t double").parquet(src)
    q = thin_stream(stream, "s", "t", 0.35).writeStream.format("memory").queryName("thinned").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.s, r.t) for r in spark.table("thinned").collect())
    assert got == [(1, 0.1), (1, 0.6), (1, 2.0), (2, 5.0)]
