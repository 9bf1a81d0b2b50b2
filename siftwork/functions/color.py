"""Colour column functions. RGB components are 0 to 255, hues degrees, Lab is D65."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hue families (name, words, hue), and words that mark an accent.
HUE_FAMILIES = (
    ("蓝", ("靛蓝", "青蓝", "孔雀蓝", "冷蓝", "浅蓝", "蓝"), 210.0),
    ("红", ("暗红", "砖红", "酒红", "红"), 4.0),
    ("橙", ("旧橙", "暖橙", "橙"), 28.0),
    ("黄", ("暖黄", "沙黄", "尘黄", "金黄", "黄"), 48.0),
    ("绿", ("墨绿", "橄榄绿", "绿"), 125.0),
    ("青", ("青绿", "青"), 180.0),
    ("紫", ("紫罗兰", "紫"), 282.0),
    ("粉", ("玫瑰粉", "粉"), 335.0),
)
ACCENT_MARKERS = ("点缀", "小面积", "少量", "一块", "局部")


def hls(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue (0 to 360), lightness and saturation (0 to 1)."""
    r, g, b = (x / 255.0 for x in (r, g, b))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    light, span = (high + low) / 2.0, high - low
    sat = F.when(span == 0, 0.0).when(light <= 0.5, span / (high + low)).otherwise(span / (2.0 - high - low))
    rc, gc, bc = ((high - x) / span for x in (r, g, b))
    turn = F.when(r == high, bc - gc).when(g == high, 2.0 + rc - bc).otherwise(4.0 + gc - rc)
    hue = F.when(span == 0, 0.0).otherwise(F.pmod(turn / 6.0, F.lit(1.0)) * 360.0)
    return hue, light, sat


def hue_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 360.0 - d)


def hex_of(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r, g, b)


def rgb_of(hex_text: Column) -> Column:
    """array(r, g, b) of #RRGGBB, null for anything else."""
    parts = F.array(*[F.conv(F.substring(hex_text, i, 2), 16, 10).cast("int") for i in (2, 4, 6)])
    return F.when(hex_text.rlike("^#[0-9A-Fa-f]{6}$"), parts)


def _linear(x: Column) -> Column:
    x = x / 255.0
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of the accessibility guidelines."""
    return _linear(r) * 0.2126 + _linear(g) * 0.7152 + _linear(b) * 0.0722


def white_text(r: Column, g: Column, b: Column) -> Column:
    """Whether a label on this colour is white."""
    return luminance(r, g, b) < 0.32


def lab(r: Column, g: Column, b: Column) -> Column:
    """struct(l, a, b) of sRGB."""
    r, g, b = _linear(r), _linear(g), _linear(b)
    xyz = (
        (r * 0.412453 + g * 0.357580 + b * 0.180423) / 0.950456,
        r * 0.212671 + g * 0.715160 + b * 0.072169,
        (r * 0.019334 + g * 0.119193 + b * 0.950227) / 1.088754,
    )
    x, y, z = (F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(t * 7.787 + 16.0 / 116.0) for t in xyz)
    light = F.when(xyz[1] > 0.008856, y * 116.0 - 16.0).otherwise(xyz[1] * 903.3)
    return F.struct(light.alias("l"), ((x - y) * 500.0).alias("a"), ((y - z) * 200.0).alias("b"))


def lab_from_bytes(l8: Column, a8: Column, b8: Column) -> Column:
    """struct(l, a, b) of Lab stored in 8 bits."""
    return F.struct((l8 * 100.0 / 255.0).alias("l"), (a8 - 128.0).alias("a"), (b8 - 128.0).alias("b"))


def delta_e(p: Column, q: Column) -> Column:
    return F.sqrt(sum((F.pow(p[c] - q[c], F.lit(2.0)) for c in ("a", "b")), F.pow(p["l"] - q["l"], F.lit(2.0))))


def chroma(p: Column) -> Column:
    return F.hypot(p["a"], p["b"])


def name(r: Column, g: Column, b: Column) -> Column:
    """Descriptive name of a colour from its hue, lightness and saturation."""
    hue, light, sat = hls(r, g, b)
    # bound once by the lambda: the tree below uses each many times
    parts = F.struct(hue.alias("h"), light.alias("l"), sat.alias("s"), F.greatest(r, g, b).alias("top"))
    return F.get(F.transform(F.array(parts), lambda x: _named(x["h"], x["l"], x["s"], x["top"])), 0)


def _named(hue: Column, light: Column, sat: Column, top: Column) -> Column:

    def by(x: Column, *steps: tuple[float, str], last: str) -> Column:
        out = F.lit(last)
        for most, word in reversed(steps):
            out = F.when(x < most, word).otherwise(out)
        return out

    grey = by(light, (0.12, "墨黑"), (0.30, "炭灰"), (0.58, "中灰"), (0.82, "浅灰"), last="灰白")
    red = F.when(light < 0.38, "酒红").when(light > 0.62, "珊瑚红").otherwise("砖红")
    brown = (
        F.when(sat < 0.28, "灰褐")
        .when(hue < 25, by(light, (0.48, "赤褐"), last="陶红"))
        .when(hue < 36, by(light, (0.50, "赭石棕"), last="焦糖橙"))
        .otherwise(by(light, (0.50, "黄褐"), last="驼棕"))
    )
    green = F.when(light < 0.34, "墨绿").when(sat < 0.45, "橄榄绿").otherwise("草绿")
    blue = F.when(light < 0.32, "靛蓝").when(sat > 0.48, "钴蓝").otherwise("雾蓝")
    base = (
        F.when((hue < 15) | (hue >= 345), red)
        .when(hue < 45, brown)
        .when(hue < 72, by(sat, (0.42, "卡其黄"), last="金黄"))
        .when(hue < 155, green)
        .when(hue < 190, by(light, (0.36, "深青"), last="青绿"))
        .when(hue < 250, blue)
        .when(hue < 290, by(light, (0.38, "深紫"), last="紫罗兰"))
        .otherwise(by(light, (0.42, "暗玫红"), last="玫瑰粉"))
    )
    shaded = F.when(light > 0.78, F.concat(F.lit("浅"), base)).when((light < 0.18) & ~F.substring(base, 1, 1).isin("深", "暗"), F.concat(F.lit("深"), base)).otherwise(base)
    return F.when(top <= 22, "墨黑").when(sat < 0.10, grey).otherwise(shaded)


def hue_targets(text: Column) -> Column:
    """array of struct(family, hue): the families named in a text, in their own order; cyan is left out where a blue of that kind is named."""
    hits = []
    for family, words, hue in HUE_FAMILIES:
        named = reduce(Column.__or__, [text.contains(w) for w in words])
        if family == "青":
            named = named & ~(text.contains("青蓝") | text.contains("孔雀蓝"))
        hits.append(F.when(named, F.struct(F.lit(family).alias("family"), F.lit(hue).alias("hue"))))
    return F.array_compact(F.array(*hits))


def _of(family: str):
    return lambda x: x["family"] == family


def accent_targets(text: Column) -> Column:
    """array of struct(family, hue): families that share a clause with an accent word, by the least distance between the two.

    Each family counts once, with its nearest place; cyan yields to a blue that is nearer.
    """

    def places(clause: Column, words) -> Column:
        return F.filter(F.array(*[F.locate(w, clause) for w in words]), lambda at: at > 0)

    def pairs(clause: Column) -> Column:
        marks = places(clause, ACCENT_MARKERS)
        apart = lambda words: F.array_min(F.flatten(F.transform(places(clause, words), lambda a: F.transform(marks, lambda b: F.abs(a - b)))))
        return F.array(*[F.struct(apart(words).alias("apart"), F.lit(family).alias("family"), F.lit(hue).alias("hue")) for family, words, hue in HUE_FAMILIES])

    found = F.filter(F.flatten(F.transform(F.split(text, "[，。；;]"), pairs)), lambda x: x["apart"].isNotNull())
    nearest = {family: F.array_min(F.filter(found, _of(family))) for family, _, _ in HUE_FAMILIES}
    nearest["青"] = F.when(nearest["蓝"].isNull() | (nearest["青"] < nearest["蓝"]), nearest["青"])
    return F.transform(F.array_sort(F.array_compact(F.array(*nearest.values()))), lambda x: F.struct(x["family"].alias("family"), x["hue"].alias("hue")))
