"""The preparation plans end to end on small inputs."""

import json

import numpy as np
from test_images import folder  # noqa: F401

from siftwork.plans import preparation as P


def test_prepare_images(spark, folder, tmp_path):  # noqa: F811
    out = {r.filename: r for r in P.prepare_images(spark, str(folder), f"file://{tmp_path}/report.json").collect()}
    assert len(out) == 8 and out["broken.png"].status == "failed" and out["copy.png"].filter_reason == "exact_duplicate"
    report = json.loads((tmp_path / "report.json").read_text())
    assert report["summary"]["total"] == 8 and report["summary"]["failed"] == 1


def test_timelines(spark):
    rows = [("VID-0001", float(t), 0.5 if t % 5 == 0 else 0.1) for t in range(1, 100)] + [("VID-0002", 1.0, 0.0)]
    subjects = spark.createDataFrame([("VID-0001", 100.0), ("VID-0002", 10.0)], "subject string, duration double")
    out = P.sample_timelines(spark.createDataFrame(rows, "subject string, t double, score double"), subjects).collect()
    one = [r for r in out if r.subject == "VID-0001"]
    assert sum(r.method == "scene" for r in one) == 19 and sum(r.method == "uniform" for r in one) == 11
    assert all(r.name.startswith(f"{r.subject}__") for r in out)
    times = sorted(r.t for r in one)
    assert min(np.diff(times)) >= 0.35


def test_frames_are_compared_within_their_subject(spark):
    rows = [(v, f"{v}-{i}", i, float(i), "pending", None, "same" if i == 1 else f"{v}{i}", 1.0, i << 20 * (i % 3), 0, [1.0, 2.0, float(i)]) for v in ("VID-0001", "VID-0002") for i in range(1, 6)]
    rows.append(("VID-0001", "copy", 9, 9.0, "pending", None, "same", 1.0, 1, 0, [1.0, 2.0, 1.0]))
    df = spark.createDataFrame(rows, "subject string, id string, ord long, t double, status string, filter_reason string, sha256 string, quality double, phash long, dhash long, histogram array<double>")
    subjects = spark.createDataFrame([("VID-0001", 10.0), ("VID-0002", 10.0)], "subject string, duration double")
    out, few = P.finish_frames(df, subjects, most=3, phash=0)
    got = {r.id: r for r in out.collect()}
    assert got["copy"].filter_reason == "exact_duplicate" and got["copy"].keeper == "VID-0001-1"
    assert got["VID-0002-1"].status == "kept" and few.count() == 0
    assert sum(r.status == "kept" for r in got.values() if r.subject == "VID-0001") == 3
    assert got["copy"].frame_id == "FRM-VID-0001-0006"
