"""Media files as tables: listing, profiles, probe documents, JSON documents and guidance texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import numeric as N
from siftwork.functions import text as T
from siftwork.operators import quality as Q

SKIPPED = ("__pycache__", ".git", ".svn")
MODIFIED = "yyyy-MM-dd'T'HH:mm:ssXXX"
# Media types of known extensions.
MIME = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".tif": "image/tiff", ".tiff": "image/tiff", ".bmp": "image/bmp",
    ".mp4": "video/mp4", ".mov": "video/quicktime", ".mkv": "video/x-matroska", ".avi": "video/x-msvideo", ".webm": "video/webm", ".json": "application/json", ".md": "text/markdown", ".txt": "text/plain",
}
PROBE = (
    "struct<streams: array<struct<index: int, codec_type: string, codec_name: string, codec_long_name: string, pix_fmt: string, width: int, height: int, duration: string,"
    " avg_frame_rate: string, r_frame_rate: string, time_base: string, sample_aspect_ratio: string, display_aspect_ratio: string, color_space: string, color_transfer: string,"
    " color_primaries: string, field_order: string, tags: map<string,string>, side_data_list: array<struct<rotation: string>>>>, format: struct<format_name: string, duration: string>>"
)


def list_files(spark: SparkSession, roots: list[str], recursive: bool = True, content: bool = False) -> DataFrame:
    """(path, name, length, modified[, content]) of all files under the roots, each once; hidden tool folders are skipped.

    Without ``content`` no byte of a file is read. A root that does not exist is an error row
    of :func:`missing_roots`, not an exception.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    known = [r for r in roots if exists(spark, r)]
    if not known:
        return spark.createDataFrame([], "path string, name string, length bigint, modified timestamp" + ", content binary" * content)
    df = reader.load(known).select("path", "length", F.col("modificationTime").alias("modified"), *["content"] * content)
    parts = F.split("path", "/")
    return df.filter(~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED)))).dropDuplicates(["path"]).withColumn("name", T.base_name(F.col("path")))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def missing_roots(spark: SparkSession, roots: list[str]) -> DataFrame:
    return spark.createDataFrame([(r, "missing input") for r in roots if not exists(spark, r)], "path string, error string")


def images(files: DataFrame, generated: bool = True) -> DataFrame:
    """Image files by extension; derived sheets and cards are left out where not wanted."""
    out = files.filter(T.extension(F.col("name")).isin(*Q.IMAGES))
    return out if generated else out.filter(~Q.is_generated(F.col("name")))


def media_records(files: DataFrame, root: str) -> DataFrame:
    """The common profile: path, original_name, extension, size_bytes, modified_at, mime_type, sha256, media_type, asset_id.

    ``files`` needs content; digests are computed in the scan's tasks.
    """
    ext = T.extension(F.col("name"))
    mime = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    base = Q.asset_ids(files)
    return base.select(
        T.relative_path(F.col("path"), root).alias("path"), F.col("name").alias("original_name"), ext.alias("extension"), F.col("length").alias("size_bytes"),
        F.date_format("modified", MODIFIED).alias("modified_at"), F.try_element_at(mime, ext).alias("mime_type"), F.sha2("content", 256).alias("sha256"), "media_type", "asset_id",
    )


def probe_records(probes: DataFrame, text: str = "probe") -> DataFrame:
    """Video profile of probe documents (JSON text): the first video stream, its duration, rates, rotation and display size.

    Unreadable documents and those without a video stream are rows with status
    failed. The container's duration counts where the stream's is missing or 0.
    """
    p = F.from_json(F.col(text), PROBE)
    df = probes.withColumn("_p", p)
    video = F.get(F.filter("_p.streams", lambda s: s["codec_type"] == "video"), 0)
    df = df.withColumn("_v", video)
    own = N.parse_float(F.col("_v.duration"))
    turned = N.rotation(F.try_element_at(F.col("_v.tags"), F.lit("rotate")), F.transform("_v.side_data_list", lambda x: x["rotation"]))
    sideways = turned.isin(90, 270)
    error = F.when(F.col("_p").isNull() | F.col("_p.streams").isNull(), "unreadable probe").when(F.col("_v").isNull(), "no_video_stream")
    return df.select(
        *[c for c in probes.columns if c != text],
        F.col("_p.format.format_name").alias("container"),
        F.coalesce(F.nullif(own, F.lit(0.0)), N.parse_float(F.col("_p.format.duration"))).alias("duration_seconds"),
        F.size(F.filter("_p.streams", lambda s: s["codec_type"] == "video")).alias("video_stream_count"),
        F.size(F.filter("_p.streams", lambda s: s["codec_type"] == "audio")).alias("audio_stream_count"),
        F.col("_v.index").alias("stream_index"), F.col("_v.codec_name").alias("codec"), F.col("_v.codec_long_name").alias("codec_long_name"), F.col("_v.pix_fmt").alias("pixel_format"),
        F.col("_v.width").alias("width"), F.col("_v.height").alias("height"),
        F.when(sideways, F.col("_v.height")).otherwise(F.col("_v.width")).alias("display_width"), F.when(sideways, F.col("_v.width")).otherwise(F.col("_v.height")).alias("display_height"),
        F.col("_v.sample_aspect_ratio").alias("sample_aspect_ratio"), F.col("_v.display_aspect_ratio").alias("display_aspect_ratio"),
        N.parse_fraction(F.col("_v.avg_frame_rate")).alias("average_frame_rate"), F.col("_v.avg_frame_rate").alias("average_frame_rate_raw"),
        N.parse_fraction(F.col("_v.r_frame_rate")).alias("real_frame_rate"), F.col("_v.r_frame_rate").alias("real_frame_rate_raw"), F.col("_v.time_base").alias("time_base"),
        turned.alias("rotation_degrees"), F.col("_v.color_space").alias("color_space"), F.col("_v.color_transfer").alias("color_transfer"), F.col("_v.color_primaries").alias("color_primaries"),
        F.col("_v.field_order").alias("field_order"), N.tone_mapped(F.col("_v.color_transfer"), F.col("_v.color_primaries")).alias("tone_mapped"),
        F.when(error.isNull(), "inspected").otherwise("failed").alias("status"), error.alias("error"),
    )


def strict_probe(records: DataFrame) -> DataFrame:
    """The stricter reading: a missing or non-positive duration is a failure too."""
    bad = F.col("error").isNull() & ~F.coalesce(F.col("duration_seconds") > 0, F.lit(False))
    return records.withColumn("error", F.when(bad, "invalid duration").otherwise(F.col("error"))).withColumn("status", F.when(bad, "failed").otherwise(F.col("status")))


def text_documents(spark: SparkSession, root: str, patterns: tuple[str, ...] = ("*.md", "*.json")) -> DataFrame:
    """(path, text) of whole documents under a root, as UTF-8; text is null where the bytes are not UTF-8."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(patterns) + "}").load(root)
    return df.select(T.relative_path(F.regexp_replace("path", "^file:/+", "/"), root).alias("path"), F.expr("try_validate_utf8(cast(content as string))").alias("text"))


def json_state(text):
    """missing, empty, unreadable or ok: four distinct findings about a JSON document."""
    return F.when(text.isNull(), "missing").when(T.is_blank(text), "empty").when(F.try_parse_json(text).isNull(), "unreadable").otherwise("ok")


def guidance(texts: DataFrame, group: str, text: str) -> DataFrame:
    """(group, guidance): the first colour line, else the first line of the visual-lock section, else the group's name."""
    lines = texts.select(group, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("i", "line")).withColumn("line", F.trim("line"))
    w = lines.groupBy(group).agg(
        F.min_by("line", F.when(F.col("line").startswith("- **色彩"), F.col("i"))).alias("colour"), F.min(F.when(F.col("line") == "## 视觉锁", F.col("i"))).alias("lock")
    )
    after = lines.join(w.select(group, "lock"), group).filter(F.col("i") > F.col("lock"))
    ends = after.groupBy(group).agg(F.min(F.when(F.col("line").startswith("#"), F.col("i"))).alias("end"))
    inner = after.join(ends, group).filter(F.col("end").isNull() | (F.col("i") < F.col("end"))).filter("line <> ''")
    locked = inner.groupBy(group).agg(F.min_by("line", "i").alias("locked"))
    coloured = F.when(F.col("colour").startswith("- **色彩"), F.col("colour"))
    return w.join(locked, group, "left").select(group, F.coalesce(coloured, "locked", F.col(group)).alias("guidance"))
