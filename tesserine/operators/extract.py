"""Image features (S2, V17-V23): what NumPy can compute from pixels, and a registry for models.

Pixels come from Spark's image source, rows of bytes in the order blue, green, red.
Models that need libraries that aren't installed (a CNN, SIFT, ORB) are registered by
the user as functions from a list of (height, width, 3) arrays to a matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: User models by name.
EXTRACTORS: dict[str, Callable[[list[np.ndarray]], np.ndarray]] = {}
MEAN, STD = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, channels, data); files that can't be decoded are left out and listed by failures()."""
    found = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(folder)
    return found.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def failures(found: DataFrame) -> DataFrame:
    return found.filter("height <= 0").select("path")


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with pixel centres at half places."""
    h, w = pixels.shape[:2]
    y, x = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1), np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    p = pixels.astype(float).reshape(h, w, -1)
    return (p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx) * (1 - fy) + (p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx) * fy


def preprocess(bgr: np.ndarray, size: int = 224) -> np.ndarray:
    """(3, size, size) of normalised red, green and blue."""
    return ((resize(bgr[:, :, ::-1], size, size) / 255 - MEAN) / STD).transpose(2, 0, 1)


def gray(bgr: np.ndarray) -> np.ndarray:
    return bgr[:, :, 2] * 0.299 + bgr[:, :, 1] * 0.587 + bgr[:, :, 0] * 0.114


def _bits(flags: np.ndarray) -> int:
    return int(np.packbits(flags.ravel()).view(">i8")[0])


def perceptual_hashes(bgr: np.ndarray) -> tuple[int, int, int]:
    """Average, difference and DCT hash, 64 bits each as signed longs."""
    g = gray(bgr)[:, :, None]
    small = resize(g, 8, 8)[:, :, 0]
    wide = resize(g, 8, 9)[:, :, 0]
    n = 32
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ resize(g, n, n)[:, :, 0] @ basis.T)[:8, :8]
    return _bits(small > small.mean()), _bits(wide[:, 1:] > wide[:, :-1]), _bits(low > np.median(low))


def colour_histogram(bgr: np.ndarray, grid: int = 2, bins: int = 8) -> np.ndarray:
    """Regions of a grid, then blue, green, red, then bins; each histogram sums to one."""
    h, w = bgr.shape[:2]
    out = []
    for r in range(grid):
        for c in range(grid):
            part = bgr[r * h // grid : (r + 1) * h // grid, c * w // grid : (c + 1) * w // grid]
            for channel in range(3):
                counts = np.bincount((part[:, :, channel].ravel().astype(int) * bins) // 256, minlength=bins).astype(float)
                out.append(counts / max(1.0, counts.sum()))
    return np.concatenate(out).astype(np.float32)


def pooled(descriptors: np.ndarray | None, dim: int) -> np.ndarray:
    """The mean of an image's local descriptors, zeros without any."""
    return np.zeros(dim, np.float32) if descriptors is None or not len(descriptors) else descriptors.mean(axis=0).astype(np.float32)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, h, w, c, data in zip(*(x.to_pylist() for x in batch.columns)):
            if h <= 0:
                out.append((path, 0, 0, 0, [0.0] * 96))
                continue
            pixels = np.frombuffer(data, np.uint8).reshape(h, w, c)
            pixels = np.repeat(pixels, 3, axis=2) if c == 1 else pixels[:, :, :3]
            out.append((path, *perceptual_hashes(pixels), colour_histogram(pixels).tolist()))
        names = ["path", "ahash", "dhash", "phash", "hist"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], pa.schema([("path", pa.string()), ("ahash", pa.int64()), ("dhash", pa.int64()), ("phash", pa.int64()), ("hist", pa.list_(pa.float32()))]))


def described(found: DataFrame) -> DataFrame:
    """V17, V23 of every image; zeros for those that can't be decoded."""
    return found.select("path", "height", "width", "channels", "data").mapInArrow(_described, "path string, ahash long, dhash long, phash long, hist array<float>")


def extracted(found: DataFrame, name: str) -> DataFrame:
    """(path, features) by a registered model, for batches of images."""
    model = EXTRACTORS[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for r in batch.to_pylist() if r["height"] > 0]
            values = model([np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"]) for r in rows]) if rows else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays([pa.array([r["path"] for r in rows], pa.string()), pa.array(values.tolist(), pa.list_(pa.float64()))], ["path", "features"])

    return found.select("path", "height", "width", "channels", "data").mapInArrow(run, "path string, features array<double>")


def principal_components(rows: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """(image_id, components) centred on the mean, and the share of variance explained; the sign of a component is arbitrary."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = rows.select("image_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(v).transform(v)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(centred)
    return model.transform(centred).select("image_id", vector_to_array("p").alias("components")), list(model.explainedVariance)
