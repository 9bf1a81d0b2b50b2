"""Ordered quality rules, listing order, asset ids, even down-sampling and name collisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.session import stored

# File kinds by extension.
IMAGES = (".jpg", ".jpeg", ".png", ".webp", ".tif", ".tiff", ".bmp")
VIDEOS = (".mp4", ".mov", ".mkv", ".avi", ".webm", ".m4v", ".mts", ".m2ts", ".wmv")
#: Extensions of other media, for names that only their type gives away.
OTHER_IMAGES = (".gif", ".heic", ".heif", ".svg", ".ico", ".avif", ".pnm", ".ppm", ".pgm", ".pbm", ".xbm", ".xpm", ".ras", ".ief", ".jpe", ".rgb", ".xwd")
OTHER_VIDEOS = (".mpeg", ".mpg", ".mpe", ".m1v", ".mpa", ".mp2v", ".qt", ".flv", ".3gp", ".3g2", ".ogv", ".movie")
GENERATED_MARKS, GENERATED_PREFIX = ("-色卡", "-纯色色卡", "色卡总览"), "总览-"


def quality_ladder(width: Column, height: Column, mean: Column, dark: Column, bright: Column, sharpness: Column, short_edge: int = 360, blur: float = 35.0) -> tuple[Column, Column, Column]:
    """status, filter_reason and review_required. The rules are tried in order; blur only asks for a review."""
    black = (mean < 6) & (dark > 0.985)
    white = (mean > 249) & (bright > 0.985)
    small = F.least(width, height) < short_edge if short_edge else F.lit(False)
    reason = F.when(black, "black_frame").when(white, "white_frame").when(small, f"short_edge_below_{short_edge}")
    review = reason.isNull() & (sharpness < blur) if blur > 0 else F.lit(False)
    return F.when(reason.isNull(), "pending").otherwise("filtered"), reason, F.coalesce(review, F.lit(False))


def media_type(name: Column) -> Column:
    ext = T.extension(name)
    return F.when(ext.isin(*IMAGES), "image").when(ext.isin(*VIDEOS), "video").when(ext.isin(*OTHER_IMAGES), "image").when(ext.isin(*OTHER_VIDEOS), "video").otherwise("unsupported")


def is_generated(name: Column) -> Column:
    return F.greatest(*[name.contains(x) for x in GENERATED_MARKS]) | name.startswith(GENERATED_PREFIX)


def numbered(df: DataFrame, partition: list[str], order: list, name: str = "n", total: str | None = None) -> DataFrame:
    """Running number from 1 within a partition (and with ``total`` its size), dealt by range so that a large partition is not sorted in one task.

    Rows are ordered by (partition, order) over all tasks and written, so that a
    row keeps its range; they are counted in each range, and the counts before
    it are added: one row per range and partition key is joined back.
    """
    keys = [F.col(c) for c in partition]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "ranged")
    local = Window.partitionBy("_part", *keys).orderBy("_row")
    counted = ranged.withColumn("_local", F.row_number().over(local))
    sizes = ranged.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy(*keys)).alias("_total"),
        *[F.col(c).alias(f"_key{i}") for i, c in enumerate(partition)],
    )
    on = (F.col("_part") == F.col("_p")) & reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(partition)], F.lit(True))
    return counted.join(sizes, on).select(*df.columns, (F.col("_local") + F.col("_before")).alias(name), *([F.col("_total").alias(total)] if total else []))


def asset_ids(files: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """Add media_type and asset_id: IMG-0001, VID-0001, UNSUPPORTED-0001 … by folded path within each type.

    An id that stands in the file's stem is used instead; the number it would
    have had is not given to another file, so ids may collide and are to be checked.
    """
    typed = files.withColumn("media_type", media_type(F.col(name))).withColumn("_fold", T.casefold(F.col(path)))
    typed = numbered(typed, ["media_type"], [F.col("_fold"), F.col(path)], "_n")
    n = F.col("_n")
    prefix = F.when(F.col("media_type") == "image", "IMG").when(F.col("media_type") == "video", "VID").otherwise("UNSUPPORTED")
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    own = F.when(F.col("media_type") == "image", F.upper(F.regexp_extract(stem, r"(?i)\b(IMG-[0-9]{4})\b", 1))).when(F.col("media_type") == "video", F.upper(F.regexp_extract(stem, r"(?i)\b(VID-[0-9]{4})\b", 1)))
    given = F.format_string("%s-%04d", prefix, n)
    return typed.withColumn("asset_id", F.when(F.coalesce(own != "", F.lit(False)), own).otherwise(given)).drop("_fold", "_n")


def even_indexes(n: Column, most: Column) -> Column:
    """Positions (from 0) of ``most`` rows spread evenly over n, first and last among them; all where n is not more."""
    spread = F.transform(F.sequence(F.lit(0), F.greatest(most, F.lit(2)) - 1), lambda i: F.bround(i.cast("double") * (n - 1) / F.greatest(most - 1, F.lit(1))).cast("int"))
    one = F.array(F.floor(n / 2).cast("int"))
    return F.when(n <= most, F.sequence(F.lit(0), F.greatest(n.cast("int"), F.lit(1)) - 1)).when(most == 1, one).otherwise(F.array_distinct(spread))


def limit_kept(frames: DataFrame, by: list[str], order: list[str], most: str) -> DataFrame:
    """Down-sample kept rows of each group evenly to the group's ``most``; the others become filtered (max_kept_limit)."""
    w = Window.partitionBy(*by, "status")
    kept = F.col("status") == "kept"
    rows = frames.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    stays = F.array_contains(even_indexes(F.col("_n"), F.col(most)), F.col("_i").cast("int"))
    drop = kept & ~stays
    out = rows.withColumn("filter_reason", F.when(drop, "max_kept_limit").otherwise(F.col("filter_reason"))).withColumn("status", F.when(drop, "filtered").otherwise(F.col("status")))
    return out.drop("_i", "_n")


def unique_names(files: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """Add destination: the name, or name__2, name__3 … for later files with it."""
    rows, n = numbered(files, [*by, name], [F.col(c) for c in order], "_n"), F.col("_n")
    stem, ext = F.regexp_replace(F.col(name), r"(?<=.)\.[^.]*$", ""), F.regexp_extract(F.col(name), r".(\.[^.]*)$", 1)
    return rows.withColumn("destination", F.when(n == 1, F.col(name)).otherwise(F.concat(stem, F.lit("__"), n, ext))).drop("_n")
