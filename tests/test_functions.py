"""Column functions against plain Python."""

import colorsys
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from siftwork.functions import color as C
from siftwork.functions import hashing as H
from siftwork.functions import numeric as N
from siftwork.functions import text as T
from siftwork.operators import quality as Q


def one(spark, rows, schema, **columns):
    return spark.createDataFrame(rows, schema).select("*", *[c.alias(n) for n, c in columns.items()]).collect()


def test_fractions_and_floats(spark):
    rows = [("30000/1001", 30000 / 1001), ("25", 25.0), ("0/0", None), ("N/A", None), ("", None), (None, None), ("1/0", None), ("x", None), ("1/2/3", None), ("-1/2", -0.5)]
    for r in one(spark, rows, "s string, want double", got=N.parse_fraction(F.col("s"))):
        assert r.got == r.want, r
    rows = [("1.5", 1.5), ("-1", None), ("nan", None), (None, None), ("abc", None), ("0", 0.0)]
    for r in one(spark, rows, "s string, want double", got=N.parse_float(F.col("s"))):
        assert r.got == r.want, r


def test_rotation(spark):
    rows = [("90", None, 90), ("-90.0", None, 270), (None, ["bad", "180"], 180), ("bad", ["-90"], 270), (None, None, 0), (None, [], 0), ("450", None, 90)]
    for r in one(spark, rows, "tag string, side array<string>, want int", got=N.rotation(F.col("tag"), F.col("side"))):
        assert r.got == r.want, r


def test_thresholds_and_even_times(spark):
    assert N.scene_thresholds(0.32) == [0.32, 0.26, 0.20, 0.38, 0.45, 0.55]
    assert N.scene_thresholds(0.2) == [0.2, 0.26, 0.38, 0.45, 0.55]
    assert N.scene_thresholds(9)[0] == 0.95
    rows = [(100.0, 4), (100.0, 1), (100.0, 0), (0.5, 2)]
    for r in one(spark, rows, "d double, n int", got=N.evenly_spaced(F.col("d"), F.col("n"))):
        margin = min(0.5, r.d * 0.08)
        span = r.d - 2 * margin
        want = [] if r.n == 0 else [margin + span / 2] if r.n == 1 else [margin + span / (r.n + 1) * (i + 1) for i in range(r.n)]
        assert r.got == pytest.approx(want)


def test_paths(spark):
    rows = [("a/b", True), ("/a", False), ("a\\b", False), ("C:x", False), ("../a", False), ("a/./b", True), ("", False), (None, False), ("  ", False), ("a/../b", False), ("a..b/c", True), (".", True)]
    for r in one(spark, rows, "p string, want boolean", got=T.portable_path(F.col("p"))):
        assert r.got == r.want, r
    rows = [("/c/a/x.PNG", "a/x.PNG", ".png"), ("/d/y", "y", ""), ("/c/.hidden", ".hidden", "")]
    for r in one(spark, rows, "p string, rel string, ext string", rel_got=T.relative_path(F.col("p"), "/c"), ext_got=T.extension(F.col("p"))):
        assert (r.rel_got, r.ext_got) == (r.rel, r.ext)


def test_privacy_patterns(spark):
    rows = [
        ("see /home/x/y", "home"), (r"at C:\Users\x\y", "home"), (r"at C:\\Users\\x", "home"), ("api_key=abcdefgh12", "secret"), ("mail a.b@c.org", "email"), ("u?X-Amz-Signature=zz", "signed"), ("clean text", ""), ('token = "abcdefghij"', ""),
    ]
    got = one(spark, rows, "t string, want string", home=T.private_path(F.col("t")), secret=F.col("t").rlike(T.CREDENTIAL), email=F.col("t").rlike(T.EMAIL), signed=F.col("t").rlike(T.SIGNED_URL))
    for r in got:
        assert [k for k in ("home", "secret", "email", "signed") if r[k]] == ([r.want] if r.want else []), r
    rows = [("in /pack/a and /home/me/b c", "in ./a and <private-path> c"), (r"C:\Users\me\x y", "<private-path> y")]
    for r in one(spark, rows, "t string, want string", got=T.redact(F.col("t"), "/pack")):
        assert r.got == r.want


def test_names_and_times(spark):
    rows = [("VID-0001__000000001500__scene__0002.jpg", ("VID-0001", 1500, "scene", 2)), ("other.jpg", (None, None, None, None)), ("VID-0001__000000001500__odd__0002.jpg", (None, None, None, None)), ("VID-0001__000000001500__scene__x.jpg", (None, None, None, None))]
    for r in one(spark, [(n,) for n, _ in rows], "n string", p=T.frame_parts(F.col("n")), i=T.frame_identity(F.col("n"))):
        assert tuple(r.p) == dict(rows)[r.n]
        assert tuple(r.i) == ((1500, "scene", "VID-0001") if r.p.video else (0, "frame", r.n.removesuffix(".jpg")))
    made = T.frame_name(F.format_string("VID-%04d", "v"), F.col("s"), F.lit("scene"), F.col("n"))
    rows = [(9_999, 1.5, 9_999), (10_000, 1.5, 1), (89_999, 9_257_998.457, 10_000), (7, 1e9, 1)]  # more digits than the padding
    for r in one(spark, rows, "v long, s double, n long", p=T.frame_parts(made)):
        assert tuple(r.p) == (f"VID-{r.v:04d}", round(r.s * 1000), "scene", r.n)
    rows = [(0, "00:00.000"), (61_001, "01:01.001"), (3_600_000, "01:00:00.000"), (-5, "00:00.000")]
    for r in one(spark, rows, "ms long, want string", got=T.format_timestamp(F.col("ms"))):
        assert r.got == r.want
    row = one(spark, [("VID-0007", 0.0125)], "v string, s double", got=T.frame_name(F.col("v"), F.col("s"), F.lit("uniform"), F.lit(3)))[0]
    assert row.got == "VID-0007__000000000012__uniform__0003.jpg"  # half to even
    rows = [("x", 1, 1, "x.jpg"), ("x", 2, 3, "x-02.jpg")]
    for r in one(spark, rows, "s string, p int, n int, want string", got=T.page_name(F.col("s"), F.lit(".jpg"), F.col("p"), F.col("n"))):
        assert r.got == r.want
    rows = [(" T ", None, "f", "T"), (None, "P", "f", "P"), (None, " ", "海-风格包-v2", "海"), (None, None, "海-风格包", "海")]
    for r in one(spark, rows, "e string, p string, f string, want string", got=T.title(F.col("e"), F.col("p"), F.col("f"))):
        assert r.got == r.want


def test_normal_text_and_hex(spark):
    rows = [("  A \n b\tß ", "a b ss"), (None, ""), ("", "")]
    for r in one(spark, rows, "t string, want string", got=T.normalized(F.col("t"))):
        assert r.got == r.want
    assert one(spark, [("x #a0B1c2 y #123 #FFFFFF7",)], "t string", got=T.hex_tokens(F.col("t")))[0].got == ["#A0B1C2", "#FFFFFF"]


def test_folding_of_every_character_and_of_long_texts(spark):
    letters = [chr(c) for c in range(1, 0x1F000) if not 0xD800 <= c < 0xE000 and chr(c).lower().islower() | (chr(c).casefold() != chr(c))]
    words = ["".join(letters[i : i + 50]) for i in range(0, len(letters), 50)] + letters + ["ΟΔΟΣ Οδος ΣΑΣ", "Straße", "ﬁﬂ", "İI"]
    got = [r.got for r in spark.createDataFrame(list(enumerate(words)), "i int, t string").coalesce(1).orderBy("i").select(T.casefold(F.col("t")).alias("got")).collect()]
    assert [(w, g) for w, g in zip(words, got, strict=True) if g != w.casefold()] == []
    long = [("Straße ſo ﬁn " * 20_000 + str(i), i) for i in range(8)] + [("A" + " " * 60_000 + "b" + str(i), i) for i in range(8)]
    start = time.monotonic()
    got = {r.got for r in one(spark, long, "t string, i int", got=T.normalized(F.col("t")))}
    assert got == {" ".join(t.split()).casefold() for t, _ in long}
    assert time.monotonic() - start < 30  # a class of all such characters, tried at every place, took minutes; runs of white space were rescanned from each place


def test_colours(spark):
    rng = random.Random(1)
    rows = [tuple(rng.randrange(256) for _ in range(3)) for _ in range(200)] + [(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128)]
    rgb = F.col("r"), F.col("g"), F.col("b")
    hue, light, sat = C.hls(*rgb)
    for x in one(spark, rows, "r int, g int, b int", hue=hue, light=light, sat=sat, hex=C.hex_of(*rgb), back=C.rgb_of(C.hex_of(*rgb)), lab=C.lab(*rgb)):
        h, l, s = colorsys.rgb_to_hls(x.r / 255, x.g / 255, x.b / 255)
        assert (x.hue, x.light, x.sat) == pytest.approx((h * 360, l, s), abs=1e-9)
        assert x.hex == f"#{x.r:02X}{x.g:02X}{x.b:02X}" and x.back == [x.r, x.g, x.b]
    white = one(spark, [(255, 255, 255), (0, 0, 0)], "r int, g int, b int", lab=C.lab(*rgb), lum=C.luminance(*rgb), white=C.white_text(*rgb))
    assert white[0].lab.l == pytest.approx(100, abs=0.01) and white[0].lum == pytest.approx(1) and not white[0].white and white[1].white
    rows = [("墨绿与孔雀蓝", ["蓝", "绿"]), ("青绿", ["绿", "青"]), ("none", [])]
    for x in one(spark, rows, "t string, want array<string>", got=C.hue_targets(F.col("t"))):
        assert [f.family for f in x.got] == x.want


def test_hashes(spark):
    rng = random.Random(3)
    rows = [([rng.random() for _ in range(64)], [rng.randrange(256) for _ in range(72)], [float(rng.randrange(9)) for _ in range(20)], [float(rng.randrange(9)) for _ in range(20)]) for _ in range(20)]
    got = one(spark, rows, "v array<double>, c array<int>, x array<double>, y array<double>", m=H.median_hash(F.col("v")), d=H.difference_hash(F.col("c")), r=H.correlation(F.col("x"), F.col("y")), same=H.correlation(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))
    for g in got:
        middle = sorted(g.v[1:])[31]
        want = int("".join("1" if x > middle else "0" for x in g.v), 2)
        assert g.m % (1 << 64) == want
        assert g.d % (1 << 64) == int("".join("1" if g.c[9 * r + i + 1] > g.c[9 * r + i] else "0" for r in range(8) for i in range(8)), 2)
        mx, my = sum(g.x) / 20, sum(g.y) / 20
        cov = sum((a - mx) * (b - my) for a, b in zip(g.x, g.y))
        assert g.r == pytest.approx(cov / math.sqrt(sum((a - mx) ** 2 for a in g.x) * sum((b - my) ** 2 for b in g.y)))
        assert g.same == 1


def test_quality_rules(spark):
    rows = [(500, 500, 5.0, 0.99, 0.0, 99.0, "filtered", "black_frame", False), (500, 500, 250.0, 0.0, 0.99, 99.0, "filtered", "white_frame", False), (500, 300, 99.0, 0.0, 0.0, 1.0, "filtered", "short_edge_below_360", False), (500, 500, 99.0, 0.0, 0.0, 1.0, "pending", None, True), (500, 360, 99.0, 0.0, 0.0, 35.0, "pending", None, False)]
    status, reason, review = Q.quality_ladder(*[F.col(c) for c in "whmdbs"])
    for r in one(spark, rows, "w int, h int, m double, d double, b double, s double, want string, why string, look boolean", status=status, reason=reason, review=review):
        assert (r.status, r.reason, r.review) == (r.want, r.why, r.look)


def test_even_indexes(spark):
    rows = [(n, m) for n in range(1, 30) for m in range(1, 12)]
    for r in one(spark, rows, "n int, m int", got=Q.even_indexes(F.col("n"), F.col("m"))):
        if r.n <= r.m:
            want = list(range(r.n))
        else:
            want = sorted({round(i * (r.n - 1) / (r.m - 1)) if r.m > 1 else r.n // 2 for i in range(r.m)})
        assert sorted(r.got) == want, r


def test_ids_and_names(spark):
    files = [("b/IMG-0007.png",), ("a/x.jpg",), ("a/Y.JPG",), ("c/clip.mov",), ("c/notes.txt",), ("a/vid-0003 take.mp4",)]
    df = spark.createDataFrame(files, "path string").withColumn("name", T.base_name(F.col("path")))
    got = {r.path: r.asset_id for r in Q.asset_ids(df).collect()}
    assert got == {"a/x.jpg": "IMG-0001", "a/Y.JPG": "IMG-0002", "b/IMG-0007.png": "IMG-0007", "a/vid-0003 take.mp4": "VID-0003", "c/clip.mov": "VID-0002", "c/notes.txt": "UNSUPPORTED-0001"}
    rows = spark.createDataFrame([(1, "a.jpg"), (2, "a.jpg"), (3, "b"), (4, "b")], "i int, n string").withColumn("d", F.lit("x"))
    assert [r.destination for r in Q.unique_names(rows, ["d"], "n", ["i"]).orderBy("i").collect()] == ["a.jpg", "a__2.jpg", "b", "b__2"]


def test_numbers_over_many_tasks(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3) or None, rng.randrange(1000), i) for i in range(500)]
    df = spark.createDataFrame(rows, "p int, o int, i int").repartition(7)
    got = {r.i: r.n for r in Q.numbered(df, ["p"], [F.col("o"), F.col("i")]).collect()}
    for p in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == p), key=lambda r: r[1:]), 1):
            assert got[r[2]] == n
