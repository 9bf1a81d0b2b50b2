"""Bit hashes of small numeric rasters, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_bits(bits: Column) -> Column:
    """Fold an array of booleans to a long, first bit highest (shift and or: no overflow at bit 64)."""
    return F.aggregate(F.transform(bits, lambda b: F.when(b, 1).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def median_hash(values: Column) -> Column:
    """64 values: a bit for each that exceeds the median of all but the first."""
    rest = F.array_sort(F.slice(values, 2, 63))
    return pack_bits(F.transform(values, lambda x: x > F.element_at(rest, 32)))


def difference_hash(cells: Column, width: int = 9) -> Column:
    """Rows of ``width`` cells: a bit for each cell that is brighter than the one to its left."""
    return pack_bits(F.filter(F.transform(cells, lambda x, i: F.when(i % width > 0, x > F.get(cells, i - 1))), lambda b: b.isNotNull()))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays; 1 where either does not vary."""
    n = F.size(a).cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    sa, sb = total(F.transform(a, lambda v: v.cast("double"))), total(F.transform(b, lambda v: v.cast("double")))
    top, bottom = dot(a, b) - sa * sb / n, (dot(a, a) - sa * sa / n) * (dot(b, b) - sb * sb / n)
    return F.when(F.abs(bottom) > 1e-12, top / F.sqrt(bottom)).otherwise(1.0)


def dct_basis(size: int = 32, kept: int = 8) -> list[list[float]]:
    """Orthonormal cosine basis, the lowest ``kept`` rows."""
    return [[math.sqrt((1 if k == 0 else 2) / size) * math.cos(math.pi * (2 * i + 1) * k / (2 * size)) for i in range(size)] for k in range(kept)]
