"""The two preparation plans: a folder of images, and timelines of candidate frames.

Both end in item tables with a status each and a summary; reports are written by
:mod:`siftwork.sources.sinks`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import numeric as N
from siftwork.functions import text as T
from siftwork.operators import dedupe, images, quality, timeline
from siftwork.sources import media, sinks
from siftwork.session import stored


def prepare_images(spark: SparkSession, folder: str, report: str | None = None, short_edge: int = 360, blur: float = 35.0) -> DataFrame:
    """Analyse, filter and de-duplicate all images of a folder: one row an image, failures included.

    With ``report`` a JSON document with settings and counts is written there.
    """
    same = F.regexp_replace("path", "^file:/+", "/")
    files = media.images(media.list_files(spark, [folder], content=True), generated=False)
    digests = files.select(same.alias("path"), F.sha2("content", 256).alias("sha256"))
    metrics = images.analyse(images.load(spark, folder, recursive=True)).withColumn("path", same)
    items = stored(images.items(metrics.join(digests.select("path"), "path", "left_semi"), digests, blur, short_edge), "items")
    out = stored(dedupe.deduplicate(items), "deduplicated")
    if report:
        summary = dedupe.status_summary(out).first().asDict()
        sinks.write_document(spark, report, {"settings": {"short_edge": short_edge, "blur": blur}, "summary": summary})
    return out


def sample_timelines(scored: DataFrame, subjects: DataFrame, initial: float = 0.32) -> DataFrame:
    """(subject, t, method, sequence, name) of the frames to look at.

    ``scored``: subject (VID-0001 …), t, score; ``subjects``: subject, duration.
    Changes above the adapted threshold come first, thinned to the minimum gap
    and to the target; the rest is filled evenly.
    """
    raw, _ = N.target_counts(F.col("duration"))
    spans = subjects.withColumn("target", raw)
    chosen = timeline.adaptive_threshold(scored, spans, "subject", initial)
    scenes = scored.join(chosen.select("subject", "threshold"), "subject").filter(F.col("score") > F.col("threshold")).join(spans.select("subject", "target"), "subject")
    kept = stored(timeline.thin(scenes, "subject", "t", timeline.MIN_GAP, "target"), "scenes")
    even = timeline.uniform_fill(spans, kept.select("subject", "t"), "subject")
    both = kept.withColumn("method", F.lit("scene")).unionByName(even.withColumn("method", F.lit("uniform")))
    return both.withColumn("name", T.frame_name(F.col("subject"), F.col("t"), F.col("method"), F.col("sequence")))


def finish_frames(frames: DataFrame, subjects: DataFrame, most: int | None = None, phash: int = 6, dhash: int = 8, correlation: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """De-duplicate frames within their subject, down-sample what is kept, number all frames; and the subjects with too few left.

    ``frames``: subject, id, ord, t, status, filter_reason, sha256, quality, phash, dhash, histogram.
    """
    _, default = N.target_counts(F.col("duration"))
    cap = F.greatest(F.lit(3), F.lit(most) if most else default)
    clean = dedupe.deduplicate(frames, phash, dhash, correlation, within="subject").join(subjects.select("subject", cap.alias("most")), "subject")
    limited = quality.limit_kept(clean, ["subject"], ["t", "ord"], "most").drop("most")
    numbered = timeline.frame_ids(limited, "subject", "t", "ord")
    return numbered, timeline.kept_guard(numbered, "subject")
