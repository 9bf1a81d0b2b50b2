"""Text column functions: normal forms, names, paths, privacy patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The frame-name grammar (numbers are padded, so larger ones have more digits) and the patterns that count as private.
FRAME_NAME = r"^(VID-[0-9]{4,})__([0-9]{12,})__(scene|uniform|boundary)__([0-9]{4,})\.jpg$"
FRAME_PREFIX = r"^(VID-[0-9]{4})__([0-9]{12})__(scene|uniform|boundary)__[0-9]{4}"
HEX = r"#[0-9A-Fa-f]{6}"
WINDOWS_HOME = r"(?i)[A-Z]:\\(?:Users|Documents and Settings)\\"
UNIX_HOME = r"/(?:Users|home)/[^/\s]+/"
CREDENTIAL = r"""(?i)(?:api[_-]?key|access[_-]?token|refresh[_-]?token|secret|password|authorization|cookie|bearer|private[_-]?key)\s*[:=]?\s*['"]?[^\s'"]{8,}"""
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
SIGNED_URL = r"""(?i)(?:X-Amz-Signature|X-Goog-Signature|Signature|sig|token|Expires)=[^&\s"']+"""
WINDOWS_PRIVATE = r"""(?i)[A-Z]:\\(?:Users|Documents and Settings)\\[^\\\s"']+(?:\\[^\s"']*)?"""
UNIX_PRIVATE = r"""/(?:Users|home)/[^/\s]+(?:/[^\s"']*)?"""


#: Characters that lower case leaves but case folding changes, from Python's own Unicode tables.
_FOLDS = {c: c.casefold() for c in map(chr, range(0x80, 0x1F000)) if c.lower() == c != c.casefold()}
_SINGLE, _SEVERAL = ({c: f for c, f in _FOLDS.items() if (len(f) > 1) == many and c != "ß"} for many in (False, True))
#: A few ranges that hold all of them but the frequent "ß": a class of single characters would be tested one by one.
_FOLDED = "[\u00b5\u0149\u017f\u01f0\u0345\u0390\u03b0\u03c2\u03d0-\u03f5\u0587\u13f8-\u13fd\u1c80-\u1c88\u1e96-\u1e9b\u1f50-\u1f56\u1f80-\u1ff7\uab70-\uabbf\ufb00-\ufb17]"


def casefold(x: Column) -> Column:
    """Full case folding: lower case, then the foldings it leaves, each as one replacement, in texts that may need any but "ß"."""
    low = F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))
    single = F.translate(low, "".join(_SINGLE), "".join(_SINGLE.values()))
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in _SEVERAL.items()])
    return F.when(low.rlike(_FOLDED), F.aggregate(pairs, single, lambda t, p: F.replace(t, p["c"], p["f"]))).otherwise(low)


def normalized(x: Column) -> Column:
    """Trimmed, white space collapsed, folded; '' for null."""
    return casefold(F.coalesce(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit("")))


def is_blank(x: Column) -> Column:
    """True for null and for white space alone."""
    return F.coalesce(~x.rlike(r"\S"), F.lit(True))


def portable_path(x: Column) -> Column:
    """A relative POSIX path: not blank, no backslash, drive letter or leading slash, no '..' part. '.' parts pass."""
    parts = F.split(x, "/")
    bad = is_blank(x) | x.contains("\\") | x.rlike("^[A-Za-z]:") | x.startswith("/") | F.array_contains(parts, "..")
    return F.coalesce(~bad, F.lit(False))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def relative_path(path: Column, base: str) -> Column:
    """The path under ``base``, or else its last part."""
    base = base.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(base_name(path))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]*)$", 1))


def private_path(text: Column) -> Column:
    return F.replace(text, F.lit("\\\\"), F.lit("\\")).rlike(WINDOWS_HOME) | F.replace(text, F.lit("\\\\"), F.lit("\\")).rlike(UNIX_HOME)


def redact(message: Column, root: str | None = None) -> Column:
    """The collection's own root becomes '.', home directories <private-path>."""
    out = F.replace(message, F.lit(root), F.lit(".")) if root else message
    return F.regexp_replace(F.regexp_replace(out, WINDOWS_PRIVATE, "<private-path>"), UNIX_PRIVATE, "<private-path>")


def hex_tokens(text: Column) -> Column:
    """All #RRGGBB in a text, upper-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(HEX), F.lit(0)), F.upper)


def frame_name(video: Column, seconds: Column, method: Column, sequence: Column) -> Column:
    return F.format_string("%s__%012d__%s__%04d.jpg", video, F.greatest(F.lit(0), F.bround(seconds * 1000.0).cast("long")), method, sequence.cast("int"))


def frame_parts(name: Column) -> Column:
    """struct(video, timestamp_ms, method, sequence); all null where the name is none of a frame."""
    hit = name.rlike(FRAME_NAME)
    parts = [F.regexp_extract(name, FRAME_NAME, i) for i in range(1, 5)]
    return F.struct(
        F.when(hit, parts[0]).alias("video"), F.when(hit, parts[1].try_cast("long")).alias("timestamp_ms"), F.when(hit, parts[2]).alias("method"), F.when(hit, parts[3].try_cast("int")).alias("sequence")
    )


def frame_identity(name: Column) -> Column:
    """struct(timestamp_ms, method, label) for ordering; 0, 'frame' and the stem where the name is none of a frame."""
    hit = name.rlike(FRAME_PREFIX)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.struct(
        F.when(hit, F.regexp_extract(name, FRAME_PREFIX, 2).try_cast("long")).otherwise(0).alias("timestamp_ms"),
        F.when(hit, F.regexp_extract(name, FRAME_PREFIX, 3)).otherwise("frame").alias("method"),
        F.when(hit, F.regexp_extract(name, FRAME_PREFIX, 1)).otherwise(stem).alias("label"),
    )


def format_timestamp(ms: Column) -> Column:
    """[HH:]MM:SS.mmm; negative counts as 0."""
    x = F.greatest(F.coalesce(ms, F.lit(0)).cast("long"), F.lit(0))
    h, m, s = F.floor(x / 3_600_000), F.floor(x / 60_000) % 60, F.floor(x / 1000) % 60
    short = F.format_string("%02d:%02d.%03d", m, s, x % 1000)
    return F.when(h > 0, F.format_string("%02d:%02d:%02d.%03d", h, m, s, x % 1000)).otherwise(short)


def page_name(stem: Column, suffix: Column, page: Column, pages: Column) -> Column:
    """stem.jpg, or stem-NN.jpg where there are several pages."""
    return F.when(pages > 1, F.format_string("%s-%02d%s", stem, page.cast("int"), suffix)).otherwise(F.concat(stem, suffix))


def title(explicit: Column, project: Column, folder: Column) -> Column:
    """The explicit title, the manifest's project, or the folder's name without its type and version suffix."""
    given = [F.when(~is_blank(x), F.trim(x)) for x in (explicit, project)]
    return F.coalesce(*given, F.regexp_replace(folder, "-风格包(?:-v[0-9]+)?$", ""))
