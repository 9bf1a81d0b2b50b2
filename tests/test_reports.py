"""Image headers, card pixels and the documents that the plans leave behind."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_images import png

from siftwork.operators import images, palette
from siftwork.plans import reports, validation
from siftwork.plans import rules as R
from siftwork.sources import headers, sinks


def exif(turned, order=">"):
    mark = b"MM\0*" if order == ">" else b"II*\0"
    return mark + struct.pack(order + "IHHHIHH", 8, 1, 0x0112, 3, 1, turned, 0)


def jpeg(width, height, parts=3, turned=None, icc=False, order=">"):
    segment = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0")
    if turned:
        out += segment(0xE1, b"Exif\0\0" + exif(turned, order))
    if icc:
        out += segment(0xE2, b"ICC_PROFILE\0xx")
    return out + b"\xff" + segment(0xC4, b"tables") + segment(0xC2, struct.pack(">BHHB", 8, height, width, parts))


def chunked(kind, *chunks):
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 30, 20, 8, kind, 0, 0, 0)) + b"".join(chunk(*c) for c in chunks) + chunk(b"IEND", b"")


CASES = {
    "a.jpg": (jpeg(30, 20), (30, 20, "RGB", "JPEG", False, 1, False, None)), "b.jpg": (jpeg(30, 20, 1, 6, True), (20, 30, "L", "JPEG", True, 6, True, None)),
    "c.jpg": (jpeg(30, 20, 4, 3, order="<"), (30, 20, "CMYK", "JPEG", False, 3, False, None)), "d.jpg": (jpeg(20, 20, 3, 8), (20, 20, "RGB", "JPEG", False, 8, False, None)),
    "e.png": (chunked(6, (b"iCCP", b"x")), (30, 20, "RGBA", "PNG", True, 1, False, None)), "f.png": (chunked(0, (b"eXIf", exif(5))), (20, 30, "L", "PNG", False, 5, True, None)),
    "g.jpg": (b"\xff\xd8\xff\xe0", (None, None, None, "JPEG", None, None, None, "decode_error")), "h.png": (b"", (None,) * 7 + ("decode_error",)), "i.gif": (b"GIF89a", (None, None, None, "GIF", None, None, None, "unread_format")),
}


def test_headers(spark):
    df = spark.createDataFrame([(p, bytearray(c)) for p, (c, _) in CASES.items()], "path string, content binary")
    assert {r.path: tuple(r)[1:] for r in headers.inspect(df).collect()} == {p: want for p, (_, want) in CASES.items()}
    assert headers.inspect(df.limit(0)).count() == 0


def test_cards_from_their_pixels_pass_the_pixel_rules(spark, tmp_path):
    rgb = [(20 * i + 5, 10 * i, 100) for i in range(10)]
    card = np.zeros((1080, 1920, 3), np.uint8)
    for i, c in enumerate(rgb):
        card[(i // 5) * 540 : (i // 5 + 1) * 540, (i % 5) * 384 : (i % 5 + 1) * 384] = c
    png(tmp_path / "whole.png", card)
    card[0, 0] = (1, 2, 3)
    card[270, 192] = (9, 9, 9)
    png(tmp_path / "spoilt.png", card)
    found = headers.card_pixels(images.load(spark, str(tmp_path))).withColumn("grp", F.regexp_extract("path", r"([a-z]+)\.png$", 1)).cache()
    colors, centres = found.filter("kind = 'colour'"), found.filter("kind = 'centre'")
    assert {(r.hex, r.n) for r in colors.filter("grp = 'whole'").collect()} == {("#%02X%02X%02X" % c, 207360) for c in rgb}
    assert [tuple(r.rgb) for r in centres.filter("grp = 'whole'").orderBy("pos").collect()] == rgb
    t = {"card_colors": colors.select("grp", "hex", "n"), "one": spark.range(1)}
    assert [(r.rule, r.subject) for r in validation.findings(t, rules=[r for r in R.RULES if r[0] in ("V116", "V117")]).collect()] == [("V116", "spoilt")]
    assert centres.filter("grp = 'spoilt' and pos = 0").first().hex == "#090909"
    inspected = headers.inspect(spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content"))
    assert {(r.width, r.height, r.mode, r.format) for r in inspected.collect()} == {(1920, 1080, "RGB", "PNG")}


@pytest.fixture()
def written(spark, tmp_path):
    def write(document):
        sinks.write_document(spark, str(tmp_path / "report.json"), document)
        return json.loads((tmp_path / "report.json").read_text("utf-8"))

    return write


def test_media_report(spark, written):
    records = spark.createDataFrame([("b.JPG", "image", "inspected"), ("A.mp4", "video", "failed"), ("c.txt", "unsupported", "unsupported")], "path string, media_type string, status string")
    document, failures = reports.media_report(records, ["in"], spark.createDataFrame([("/x/lost", "missing input")], "path string, error string"), "ffprobe")
    read = written(document)
    assert read["summary"] == {"files": 3, "images": 1, "videos": 1, "unsupported": 1, "failed": 1} and failures == 2
    assert [m["path"] for m in read["media"]] == ["A.mp4", "b.JPG", "c.txt"] and read["input_errors"] == [{"path": "lost", "error": "missing input"}]


def test_frame_index_and_contact_report(spark, written):
    frames = spark.createDataFrame([("F-2", "kept", 20, None), ("F-1", "filtered", 10, "blur"), ("F-3", "kept", 30, None)], "frame_id string, status string, timestamp_ms long, filter_reason string")
    read = written(reports.frame_index("VID-0001", frames, 0, 3, {"scene_threshold": 0.32}, "still"))
    assert [f["frame_id"] for f in read["frames"]] == ["F-1", "F-2", "F-3"] and read["frames"][1]["filter_reason"] is None
    assert read["extraction"]["kept_count"] == 2 and read["extraction"]["scene_not_applicable_reason"] == "still" and read["schema_version"] == "1.0"
    assert written(reports.failed_index("VID-0002", "no stream"))["status"] == "failed"
    pages = spark.createDataFrame([("group", "g", 2, 2, 31, "g-02.jpg"), ("group", "g", 1, 2, 31, "g-01.jpg")], "kind string, name string, page int, pages int, n_items int, path string")
    assert written(reports.contact_report(pages, "pack", "all", {"columns": 5}))["sheets"] == [{"kind": "group", "name": "g", "item_count": 31, "page_count": 2, "paths": ["g-01.jpg", "g-02.jpg"]}]


def test_palette_document_round_trip(spark, written):
    rows = [("01-红", s, r, "n", f"#{i:02X}0000", i, 0, 0, 0.123456, 0.5) for i, (s, r) in enumerate(zip(palette.SLOTS, palette.ROLES))]
    made = spark.createDataFrame(rows[::-1], "group string, slot string, role string, name string, hex string, r int, g int, bl int, sample_share double, image_recurrence double")
    counts = spark.createDataFrame([("01-红", 2)], "group string, reference_count int")
    read = written(reports.palette_document(made, counts, "p", R.COLOR_MODEL))
    files = spark.createDataFrame([("参考素材/分组/01-红/IMG-0001.png", 1, 1, "RGB", "PNG"), ("参考素材/分组/01-红/IMG-0002.png", 1, 1, "RGB", "PNG")], validation.FILES)
    texts = spark.createDataFrame([("分析/色卡数据.json", json.dumps(read, ensure_ascii=False))], "path string, text string")
    names = [f"V{i}" for i in [*range(99, 104), *range(106, 116)]]
    assert validation.findings(validation.tables(files, texts), rules=[r for r in R.RULES if r[0] in names]).collect() == []
    colors = spark.createDataFrame([("g", c["slot"], c["rgb"], c["sample_share"], c["image_recurrence"]) for c in read["groups"][0]["colors"]], "grp string, slot string, rgb array<int>, sample_share double, image_recurrence double")
    back = reports.palette_candidates(colors).collect()
    assert all(r.error is None and r.weight == 0.1235 for r in back) and reports.palette_slots(colors).count() == 0
    assert reports.palette_slots(colors.filter("slot <> 'A2'")).count() == 1


def test_acceptance_document(spark, written):
    found = spark.createDataFrame([("V20", "error", "IMG /home/me/x")], "rule string, severity string, subject string")
    checks = spark.createDataFrame([("groups", "3")], "check string, value string")
    read = written(reports.acceptance_document(validation.report(found), checks, "pack", True))
    assert read["status"] == "FAIL" and read["errors"] == ["V20 IMG <private-path>"] and read["checks"] == {"groups": 3} and not read["automated_validation_passed"]
