"""Image analysis: pixels come from Spark's image source (decoded in the JVM), kernels run in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import numeric as N
from siftwork.functions import text as T
from siftwork.functions.hashing import dct_basis
from siftwork.operators import quality as Q
from siftwork.session import prepare

METRICS = (
    "path string, width int, height int, sharpness double, mean_luminance double, dark_pixel_share double, bright_pixel_share double,"
    " phash_value bigint, dhash_value bigint, histogram array<float>, error string"
)


def pixels_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB rows of an image struct (stored blue first)."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]


def grey(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def laplacian_variance(g: np.ndarray) -> float:
    """Population variance of the four-neighbour Laplacian, borders mirrored without their edge."""
    p = np.pad(g.astype(np.float64), 1, mode="reflect") if min(g.shape) > 1 else np.pad(g.astype(np.float64), 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def area_weights(source: int, target: int) -> np.ndarray:
    """target x source matrix of box averages; linear interpolation where the image is enlarged."""
    out = np.zeros((target, source))
    if target > source:
        at = np.clip((np.arange(target) + 0.5) * source / target - 0.5, 0, source - 1)
        low = np.minimum(at.astype(int), max(source - 2, 0))
        out[np.arange(target), low] = 1 - (at - low)
        out[np.arange(target), np.minimum(low + 1, source - 1)] += at - low
        return out
    edges = np.arange(target + 1) * source / target
    cells = np.arange(source)
    overlap = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    return np.maximum(overlap, 0) * target / source


def resize(g: np.ndarray, width: int, height: int) -> np.ndarray:
    return np.clip(np.rint(area_weights(g.shape[0], height) @ g @ area_weights(g.shape[1], width).T), 0, 255)


def _pack(bits: np.ndarray) -> int:
    return int(np.packbits(bits.reshape(-1)).view(">i8")[0])


_DCT = np.array(dct_basis())


def perceptual_hash(g: np.ndarray) -> int:
    """64 low frequencies of the 32 x 32 image against their median without the constant one."""
    low = _DCT @ resize(g, 32, 32) @ _DCT.T
    return _pack(low > np.median(low.reshape(-1)[1:]))


def gradient_hash(g: np.ndarray) -> int:
    small = resize(g, 9, 8)
    return _pack(small[:, 1:] > small[:, :-1])


def hue_histogram(rgb: np.ndarray) -> np.ndarray:
    """36 hue by 16 saturation bins, scaled to unit length."""
    x = rgb.reshape(-1, 3).astype(np.float64)
    high, low = x.max(1), x.min(1)
    span = high - low
    with np.errstate(all="ignore"):
        r, g, b = x.T
        turn = np.where(high == r, (g - b) / span, np.where(high == g, 2 + (b - r) / span, 4 + (r - g) / span))
        hue = np.where(span == 0, 0, np.rint(turn * 30) % 180)
        sat = np.where(high == 0, 0, np.rint(span / high * 255))
    counts = np.bincount((hue // 5).astype(int) * 16 + (sat // 16).astype(int), minlength=576).astype(np.float64)
    return (counts / max(np.linalg.norm(counts), 1e-12)).astype(np.float32)


def letterbox(rgb: np.ndarray) -> tuple[int, int, int, int]:
    """Rows and columns (top, bottom, left, right) that are left without the black border; all of them where a border takes a quarter."""
    dark = rgb @ np.array([0.2126, 0.7152, 0.0722]) < 6
    h, w = dark.shape
    cut = []
    for axis, size in ((1, h), (0, w)):
        light = np.flatnonzero(dark.mean(axis) <= 0.985)
        cut.append((int(light[0]), int(size - 1 - light[-1])) if len(light) else (size, size))
    (top, bottom), (left, right) = cut
    if top + bottom >= h * 0.25 or left + right >= w * 0.25:
        return 0, h, 0, w
    return top, h - bottom, left, w - right


def load(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, height, width, nChannels, data) of all images; undecodable ones keep their row with negative sizes."""
    df = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", recursive).load(path)
    return df.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")


def analyse(images: DataFrame) -> DataFrame:
    """Metrics, hashes and histogram of each image; an image that cannot be read has error decode_error."""
    prepare(images.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                try:
                    if r.height <= 0 or r.width <= 0:
                        raise ValueError
                    rgb = pixels_of(r.height, r.width, r.nChannels, r.data)
                    g = grey(rgb)
                    rows.append((r.path, r.width, r.height, laplacian_variance(g), float(g.mean()), float((g < 12).mean()), float((g > 243).mean()), perceptual_hash(g), gradient_hash(g), hue_histogram(rgb), None))
                except (ValueError, TypeError):
                    rows.append((r.path, None, None, None, None, None, None, None, None, None, "decode_error"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in METRICS.split(", ")])

    return images.select("path", "height", "width", "nChannels", "data").mapInPandas(run, METRICS)


def items(metrics: DataFrame, digests: DataFrame, blur: float = 35.0, short_edge: int = 360) -> DataFrame:
    """Rows for de-duplication from metrics and (path, sha256): id, ord, status, filter_reason, review_required, quality, hashes."""
    status, reason, review = Q.quality_ladder(*[F.col(c) for c in ("width", "height", "mean_luminance", "dark_pixel_share", "bright_pixel_share", "sharpness")], short_edge, blur)
    failed = F.col("error").isNotNull()
    return metrics.join(digests.select("path", "sha256"), "path", "left").select(
        F.col("path").alias("id"), T.casefold(F.col("path")).alias("ord"), T.base_name(F.col("path")).alias("filename"), "sha256", "width", "height",
        F.bround("sharpness", 4).alias("sharpness"), F.bround("mean_luminance", 4).alias("mean_luminance"), F.bround("dark_pixel_share", 6).alias("dark_pixel_share"), F.bround("bright_pixel_share", 6).alias("bright_pixel_share"),
        F.col("phash_value").alias("phash"), F.col("dhash_value").alias("dhash"), N.hash_hex(F.col("phash_value")).alias("phash_hex"), N.hash_hex(F.col("dhash_value")).alias("dhash_hex"), "histogram",
        N.quality_score(F.col("width"), F.col("height"), F.col("sharpness")).alias("quality"),
        F.when(failed, "failed").otherwise(status).alias("status"), F.when(failed, "decode_error").otherwise(reason).alias("filter_reason"), (review & ~failed).alias("review_required"), "error",
    )


def pixel_rows(images: DataFrame, edge: int = 420) -> DataFrame:
    """(path, pixel, r, g, b) without the letterbox, shrunk to ``edge`` at most: at most edge x edge rows an image."""
    prepare(images.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                if r.height <= 0:
                    continue
                rgb = pixels_of(r.height, r.width, r.nChannels, r.data)
                top, bottom, left, right = letterbox(rgb)
                rgb = rgb[top:bottom, left:right].astype(np.float64)
                scale = min(1.0, edge / max(rgb.shape[:2]))
                if scale < 1:
                    h, w = (max(1, round(n * scale)) for n in rgb.shape[:2])
                    rgb = np.stack([resize(rgb[:, :, c], w, h) for c in range(3)], axis=2)
                flat = rgb.reshape(-1, 3).astype(int)
                yield pd.DataFrame({"path": r.path, "pixel": np.arange(len(flat)), "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2]})

    return images.select("path", "height", "width", "nChannels", "data").mapInPandas(run, "path string, pixel int, r int, g int, b int")
