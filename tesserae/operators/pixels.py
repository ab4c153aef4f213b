"""Measures of images and tiles, by vectorised helpers over decoded image bytes.

Images come from Spark's own readers, which decode in the JVM: `image` for pixels
and `binaryFile` for sizes. Helpers see a batch of images at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = "veg:double,veg_guarded:double,variance:double,laplacian:double,mean:double,ahash:string"


def _rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Height x width x 3, in the order red, green, blue; readers give blue first."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]


def exg(rgb: np.ndarray, threshold: float, guarded: bool) -> float:
    """Share of pixels whose excess green 2g - r - b, of chromatic shares, passes; guarded ones are green above both others."""
    total = rgb.sum(2)
    r, g, b = np.moveaxis(np.divide(rgb, total[:, :, None], out=np.zeros_like(rgb), where=total[:, :, None] > 0), 2, 0)
    ok = 2 * g - r - b > threshold
    if guarded:
        ok &= (rgb[:, :, 1] > rgb[:, :, 0]) & (rgb[:, :, 1] > rgb[:, :, 2])
    return float(ok.mean())


def average_hash(gray: np.ndarray, side: int = 16) -> str:
    """Bits of a side x side picture of area means: brighter than their mean, as hexadecimal digits."""
    rows = np.linspace(0, gray.shape[0], side + 1)
    cols = np.linspace(0, gray.shape[1], side + 1)
    sums = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1))
    sums[1:, 1:] = gray.cumsum(0).cumsum(1)

    def at(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The summed-area table between pixels, linear in both directions."""
        y0, x0 = np.minimum(y.astype(int), gray.shape[0] - 1), np.minimum(x.astype(int), gray.shape[1] - 1)
        fy, fx = (y - y0)[:, None], (x - x0)[None, :]
        s = lambda a, b: sums[np.ix_(a, b)]
        return s(y0, x0) * (1 - fy) * (1 - fx) + s(y0 + 1, x0) * fy * (1 - fx) + s(y0, x0 + 1) * (1 - fy) * fx + s(y0 + 1, x0 + 1) * fy * fx

    table = at(rows, cols)
    small = np.diff(np.diff(table, axis=0), axis=1) / np.outer(np.diff(rows), np.diff(cols))
    return np.packbits(small.ravel() > small.mean()).tobytes().hex()


def measure(images: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(origin, width, height, veg, veg_guarded, variance, laplacian, mean, ahash) of an `image` frame."""

    @F.pandas_udf(f"struct<{MEASURES}>")
    def of(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
        out = []
        for d, h, w, c in zip(data, height, width, channels, strict=True):
            rgb = _rgb(d, h, w, c)
            gray = rgb @ np.array([0.299, 0.587, 0.114])
            edge = np.pad(gray, 1, mode="edge")
            lap = edge[:-2, 1:-1] + edge[2:, 1:-1] + edge[1:-1, :-2] + edge[1:-1, 2:] - 4 * gray
            out.append((exg(rgb, threshold, False), exg(rgb, threshold, True), float(gray.var()), float(lap.var()), float(gray.mean()), average_hash(gray)))
        return pd.DataFrame(out, columns=["veg", "veg_guarded", "variance", "laplacian", "mean", "ahash"])

    i = images.select("image.*")
    return i.select("origin", "width", "height", of("data", "height", "width", "nChannels").alias("m")).select("origin", "width", "height", "m.*")


def skip_rate(measured: DataFrame, least_variance: float, least_laplacian: float) -> DataFrame:
    """One row: images, and the share that is too flat or too blurred."""
    flat = (F.col("variance") < least_variance) | (F.col("laplacian") < least_laplacian)
    return measured.agg(F.count("*").alias("images"), F.avg(flat.cast("int")).alias("skipped"))


def broken(listing: DataFrame, decoded: DataFrame, least_bytes: int = 1024) -> DataFrame:
    """(path, reason) of files that are too small or that no decoder reads."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  readers write local paths in two ways
    listing = listing.withColumn("path", plain("path"))
    small = listing.where(F.col("length") <= least_bytes).select("path", F.lit("small").alias("reason"))
    unread = listing.where(F.col("length") > least_bytes).join(decoded.select(plain("origin").alias("path")), "path", "left_anti").select("path", F.lit("undecodable").alias("reason"))
    return small.union(unread)


def noise_share(masks: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, tile_id, noise_fraction): the share of non-black pixels of a mask within each tile box.

    masks: (image_id, image struct); boxes: (image_id, tile_id, x0, y0, x1, y1).
    """

    @F.pandas_udf("double")
    def share(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        out = []
        for d, h, w, c, a, b, e, f in zip(data, height, width, channels, x0, y0, x1, y1, strict=True):
            part = np.frombuffer(d, np.uint8).reshape(h, w, c)[b:f, a:e].max(2)
            out.append(float((part > 0).mean()) if part.size else 0.0)
        return pd.Series(out)

    t = boxes.join(masks, "image_id")
    return t.select("image_id", "tile_id", share("image.data", "image.height", "image.width", "image.nChannels", "x0", "y0", "x1", "y1").alias("noise_fraction"))


def near_hash(a: Column, b: Column, bits: int) -> Column:
    """Whether two hexadecimal hashes of 256 bits differ in at most so many."""
    part = lambda c, i: F.conv(F.substring(c, 1 + 15 * i, 15), 16, 10).cast("bigint")
    return sum((F.bit_count(part(a, i).bitwiseXOR(part(b, i))) for i in range(1, 5)), F.bit_count(part(a, 0).bitwiseXOR(part(b, 0)))) <= bits
