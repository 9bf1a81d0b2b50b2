"""Real images: PNG files written here, decoded by Spark."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.functions import color as C
from siftwork.operators import dedupe, images, palette
from siftwork.sources import media, sinks


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("pictures")
    rng = np.random.default_rng(4)
    x = np.linspace(0, 255, 400)
    base = np.stack([np.tile(x, (380, 1)), np.tile(x[:380, None], (1, 400)), rng.integers(0, 255, (380, 400))], axis=2)
    png(d / "a.png", base)
    (d / "copy.png").write_bytes((d / "a.png").read_bytes())
    png(d / "bright.png", np.clip(base + 3, 0, 255))
    png(d / "black.png", np.zeros((400, 400, 3)))
    png(d / "white.png", np.full((400, 400, 3), 255))
    png(d / "small.png", base[:300, :300])
    check = np.indices((400, 400)).sum(0) % 80 < 40
    png(d / "check.png", np.where(check[..., None], [200, 30, 40], [20, 60, 180]))
    (d / "broken.png").write_bytes(b"no image")
    (d / "notes.txt").write_text("x")
    return d


def test_analysis_and_deduplication(spark, folder):
    listing = media.images(media.list_files(spark, [str(folder)], content=True))
    digests = listing.select("path", F.sha2("content", 256).alias("sha256"))
    metrics = images.analyse(images.load(spark, f"{folder}/*.png"))
    same = lambda c: F.regexp_replace(c, "^file:/+", "/")
    items = images.items(metrics.withColumn("path", same("path")), digests.withColumn("path", same("path")))
    got = {r.filename: r for r in dedupe.deduplicate(items).collect()}
    status = {k: (r.status, r.filter_reason) for k, r in got.items()}
    assert status["black.png"] == ("filtered", "black_frame") and status["white.png"] == ("filtered", "white_frame")
    assert status["small.png"] == ("filtered", "short_edge_below_360") and status["broken.png"] == ("failed", "decode_error")
    assert status["copy.png"] == ("duplicate", "exact_duplicate") and status["a.png"][0] in ("kept", "duplicate")
    assert {status["a.png"][0], status["bright.png"][0]} == {"kept", "duplicate"}
    assert status["check.png"] == ("kept", None)
    assert got["a.png"].width == 400 and got["a.png"].height == 380 and len(got["a.png"].phash_hex) == 16
    summary = dedupe.status_summary(dedupe.deduplicate(items)).first()
    assert (summary.total, summary.failed, summary.filtered) == (8, 1, 3)


def test_kernels():
    flat = np.full((50, 60), 7, np.uint8)
    assert images.laplacian_variance(flat) == 0
    assert images.area_weights(10, 3).sum(1) == pytest.approx(np.ones(3)) and images.area_weights(3, 10).sum(1) == pytest.approx(np.ones(10))
    assert (images.resize(flat, 9, 8) == 7).all() and images.gradient_hash(flat) == 0
    x = np.zeros((100, 100, 3), np.uint8)
    x[10:90, 5:95] = 200
    assert images.letterbox(x) == (10, 90, 5, 95)
    x[:30] = 0
    assert images.letterbox(x) == (0, 100, 0, 100)  # a quarter or more: left as it is
    assert images.letterbox(np.zeros((9, 9, 3))) == (0, 9, 0, 9)
    h = images.hue_histogram(np.full((4, 4, 3), [255, 0, 0], np.uint8))
    assert len(h) == 576 and np.flatnonzero(h).tolist() == [15]


def test_palette_from_pixels(spark, folder):
    pixels = images.pixel_rows(images.load(spark, f"{folder}/*.png"), edge=60).withColumn("grp", F.lit("01-蓝"))
    guidance = spark.createDataFrame([("01-蓝", "红色，少量黄点缀")], "grp string, guidance string")
    rows = palette.build_palettes(pixels, guidance, "grp", "path", "pixel").collect()
    assert [r.slot for r in rows] == list(palette.SLOTS) and len({r.hex for r in rows}) == 10
    assert all(r.error is None and r.name and 0 <= r.sample_share <= 1 and 0 <= r.image_recurrence <= 1 for r in rows)


def test_palette_error(spark):
    rows = [("g", "", 50.0 + i, 0.0, 0.0, 0.2, 1.0) for i in range(5)]
    got = palette.palettes(spark.createDataFrame(rows, "grp string, guidance string, l double, a double, b double, weight double, recurrence double"), "grp").collect()
    assert len(got) == 1 and "ten colours" in got[0].error


def test_words_for_hues(spark):
    rows = ["大面积蓝，少量橙点缀；局部红", "蓝色为主", "孔雀蓝与青绿", "局部蓝与少量青", "局部青，点缀在远处的一大片蓝", "点缀青绿与一块红；红少量", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    got = df.orderBy("i").select(C.accent_targets(F.col("x")).alias("accents"), C.hue_targets(F.col("x")).alias("named")).collect()
    accents, named = [[(t.family, t.hue) for t in r.accents] for r in got], [[t.family for t in r.named] for r in got]
    assert accents[0] == [("橙", 28.0), ("红", 4.0)] and accents[1] == [] and named[2] == ["蓝", "绿"]
    assert [[f for f, _ in x] for x in accents[3:]] == [["蓝"], ["青", "蓝"], ["红", "绿", "青"], []]


def test_listing_probe_and_sinks(spark, folder, tmp_path):
    files = media.list_files(spark, [str(folder), str(folder), str(folder / "none")], content=True)
    assert files.count() == 9
    assert [r.error for r in media.missing_roots(spark, [str(folder), str(folder / "none")]).collect()] == ["missing input"]
    records = {r.original_name: r for r in media.media_records(files, str(folder)).collect()}
    assert records["a.png"].sha256 == records["copy.png"].sha256 and records["notes.txt"].media_type == "unsupported" and records["a.png"].mime_type == "image/png"
    probe = '{"streams":[{"codec_type":"audio"},{"codec_type":"video","index":1,"width":1920,"height":1080,"duration":"0","avg_frame_rate":"30000/1001","r_frame_rate":"0/0","color_transfer":"smpte2084","side_data_list":[{"rotation":"-90"}]}],"format":{"format_name":"mov","duration":"12.5"}}'
    rows = spark.createDataFrame([(1, probe), (2, "{}"), (3, "junk"), (4, '{"streams":[],"format":{}}'), (5, '{"streams":[{"codec_type":"video"}],"format":{"duration":"N/A"}}')], "i int, probe string")
    got = {r.i: r for r in media.strict_probe(media.probe_records(rows)).collect()}
    v = got[1]
    assert (v.duration_seconds, v.rotation_degrees, v.display_width, v.real_frame_rate, v.tone_mapped, v.status) == (12.5, 270, 1080, None, True, "inspected")
    assert [got[i].error for i in (3, 4, 5)] == ["unreadable probe", "no_video_stream", "invalid duration"]
    assert sinks.copy_files(files.filter("name = 'notes.txt'").withColumn("destination", F.lit("kept.txt")), f"file://{tmp_path}/out") == 1
    assert (tmp_path / "out" / "kept.txt").read_text() == "x"
    sinks.write_document(spark, f"file://{tmp_path}/r.json", {"名": 1})
    assert (tmp_path / "r.json").read_text() == '{\n  "schema_version": "1.0",\n  "名": 1\n}\n'
    sinks.write_rows(rows, str(tmp_path / "rows"))
    with pytest.raises(Exception):
        sinks.write_rows(rows, str(tmp_path / "rows"))


def test_guidance(spark):
    rows = [("g1", "# x\n- **色彩**：蓝\n## 视觉锁\na"), ("g2", "## 视觉锁\n\n first \n# end"), ("g3", "## 视觉锁\n# end\nlater"), ("g4", None)]
    got = {r.g: r.guidance for r in media.guidance(spark.createDataFrame(rows, "g string, t string"), "g", "t").collect()}
    assert got == {"g1": "- **色彩**：蓝", "g2": "first", "g3": "g3", "g4": "g4"}
