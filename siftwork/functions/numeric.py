"""Numeric column functions with null-on-error semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds up to which a target holds, frames wanted and frames kept; the last for longer ones.
TARGETS = ((30, 18, 18), (120, 30, 28), (300, 45, 40), (1200, 75, 70), (3600, 120, 100))
LONGEST_TARGET = (160, 120)
# Scene thresholds tried after the first one.
TRIAL_THRESHOLDS = (0.26, 0.20, 0.38, 0.45, 0.55)


def parse_fraction(text: Column) -> Column:
    """'30000/1001' or '25' as double; null for null, '', 'N/A', a zero divisor and anything unreadable."""
    parts = F.split(F.trim(text), "/")
    top = F.try_element_at(parts, F.lit(1)).try_cast("double")
    bottom = F.when(F.size(parts) == 1, F.lit(1.0)).when(F.size(parts) == 2, F.try_element_at(parts, F.lit(2)).try_cast("double"))
    value = F.try_divide(top, bottom)
    return F.when(~F.isnan(value) & text.isNotNull() & ~text.isin("", "0/0", "N/A"), value)


def parse_float(text: Column) -> Column:
    """Non-negative double, else null; NaN counts as unreadable."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (value >= 0), value)


def rotation(tag: Column, side_data: Column) -> Column:
    """Degrees from 0 to 359: the tag, else the first readable side-data entry, else 0.

    A tag that is there but unreadable falls through to the side data.
    """
    first = F.get(F.filter(F.transform(side_data, lambda x: x.try_cast("double")), lambda x: x.isNotNull()), 0)
    return F.pmod(F.coalesce(tag.try_cast("double"), first, F.lit(0.0)).cast("long"), F.lit(360)).cast("int")


def quality_score(width: Column, height: Column, sharpness: Column) -> Column:
    """Resolution in bits, ten times, plus up to six for sharpness."""
    return F.log2(F.greatest(width * height, F.lit(1)).cast("double")) * 10.0 + F.least(F.log1p(F.greatest(sharpness, F.lit(0.0))), F.lit(6.0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_hex(value: Column) -> Column:
    """16 lower-case hex digits of the 64 bits of a long."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def target_counts(duration: Column) -> tuple[Column, Column]:
    """Frames to look at and frames to keep for a duration in seconds."""
    raw, kept = F.lit(LONGEST_TARGET[0]), F.lit(LONGEST_TARGET[1])
    for most, r, k in reversed(TARGETS):
        raw, kept = F.when(duration <= most, r).otherwise(raw), F.when(duration <= most, k).otherwise(kept)
    return raw, kept


def scene_thresholds(initial: float) -> list[float]:
    """The thresholds to try in order: the first one and the fixed ones, within 0.05 and 0.95, each once."""
    return list(dict.fromkeys(min(0.95, max(0.05, x)) for x in (initial, *TRIAL_THRESHOLDS)))


def evenly_spaced(duration: Column, count: Column) -> Column:
    """``count`` inner points that divide a duration evenly, after a margin of 8 % (half a second at most) at both ends; one point is the middle."""
    margin = F.least(F.lit(0.5), duration * 0.08)
    span = F.greatest(margin, duration - margin) - margin
    many = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: margin + span / (count + 1) * i)
    return F.when(count <= 0, F.array().cast("array<double>")).when(count == 1, F.array(margin + span / 2)).otherwise(many)


def tone_mapped(transfer: Column, primaries: Column) -> Column:
    """Whether a stream needs mapping to standard range."""
    return F.coalesce(F.lower(transfer).isin("smpte2084", "arib-std-b67"), F.lit(False)) | F.coalesce(F.lower(primaries) == "bt2020", F.lit(False))
