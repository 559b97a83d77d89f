"""Image quality gate (F3): pixel metrics and the verdict cascade.

Pixel metrics need array arithmetic on decoded images, so they run as an
Arrow-batched numpy function over the rows of Spark's ``image`` source
(decoded by the JVM, BGR byte order).  The cascade itself is a native CASE
over the metric columns, so it also applies to metrics computed elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Thresholds and messages of the reference.
BLUR_THRESHOLD = 100.0
CONTRAST_THRESHOLD = 15
MIN_HEIGHT = 500
MSG_BLURRY = "The image is blurry (focus measure = %.2f)"
MSG_LOW_CONTRAST = "The image has low contrast"
MSG_LOW_RESOLUTION = "Please upload an image with higher resolution"
MSG_GOOD = "Image quality is good"
MSG_UNREADABLE = "The image cannot be read"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Spark ``image`` source; an undecodable file keeps a row without pixels."""
    return spark.read.format("image").option("dropInvalid", "false").load(path)


def _gray(data: bytes, h: int, w: int, c: int) -> np.ndarray:
    a = np.frombuffer(data, dtype=np.uint8)
    if c == 1:
        return a.reshape(h, w).astype(np.float64)
    a = a.reshape(h, w, c).astype(np.float64)
    b, g, r = a[..., 0], a[..., 1], a[..., 2]
    return np.rint(0.114 * b + 0.587 * g + 0.299 * r)


def laplacian_variance(gray: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian with mirrored borders (the edge
    pixel itself is not repeated)."""
    if gray.size == 0:
        return 0.0
    p = np.pad(gray, 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray, 1, mode="edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4.0 * p[1:-1, 1:-1]
    return float(lap.var())


def image_metrics(images: DataFrame) -> DataFrame:
    """path, height, width, contrast (max-min gray), blur (Laplacian variance);
    all but the path are null for an undecodable image."""
    src = images.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"),
                        F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"),
                        F.col("image.data").alias("data"))

    def metrics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            contrast, blur = [], []
            for data, h, w, c in zip(d["data"], d["height"], d["width"], d["channels"]):
                if not data or min(h, w, c) < 1:
                    contrast.append(None)
                    blur.append(None)
                    continue
                g = _gray(data, h, w, c)
                contrast.append(int(g.max() - g.min()) if g.size else 0)
                blur.append(laplacian_variance(g))
            yield pa.RecordBatch.from_arrays(
                [pa.array(d["path"], pa.string()), *[pa.array([None if b is None else x for x, b in zip(d[n], blur)], pa.int32())
                                                     for n in ("height", "width")],
                 pa.array(contrast, pa.int32()), pa.array(blur, pa.float64())],
                names=["path", "height", "width", "contrast", "blur"])

    return src.mapInArrow(metrics, "path string, height int, width int, contrast int, blur double")


def verdict(df: DataFrame, blur: str = "blur", contrast: str = "contrast", height: str = "height") -> DataFrame:
    """Cascade, first failure wins: unreadable (no metrics), blurry, low contrast,
    low resolution, good."""
    b, c, h = F.col(blur), F.col(contrast), F.col(height)
    none = b.isNull() | c.isNull() | h.isNull()
    v = (F.when(none, "unreadable").when(b < BLUR_THRESHOLD, "blurry").when(c < CONTRAST_THRESHOLD, "low_contrast")
         .when(h < MIN_HEIGHT, "low_resolution").otherwise("good"))
    msg = (F.when(none, F.lit(MSG_UNREADABLE)).when(b < BLUR_THRESHOLD, F.format_string(MSG_BLURRY, b))
           .when(c < CONTRAST_THRESHOLD, F.lit(MSG_LOW_CONTRAST))
           .when(h < MIN_HEIGHT, F.lit(MSG_LOW_RESOLUTION)).otherwise(F.lit(MSG_GOOD)))
    return df.withColumn("verdict", v).withColumn("ok", v == "good").withColumn("message", msg)


def verdict_summary(df: DataFrame) -> DataFrame:
    """Counts and blur range per verdict (mergeable aggregates only)."""
    return df.groupBy("verdict").agg(F.count("*").cast("bigint").alias("n"),
                                     F.min("blur").alias("min_blur"), F.max("blur").alias("max_blur"),
                                     F.percentile_approx("blur", 0.5).alias("median_blur_approx"))
