"""Tile boxes of images from their sizes: (image_id, width, height) to (image_id, tile_id, x0, y0, x1, y1).

Boxes come from sequences that are exploded, row by row of the image; fractions are rounded
half to even and clipped to the image.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _size() -> tuple[Column, Column]:
    return F.col("width"), F.col("height")


def _even(c: Column) -> Column:
    return F.bround(c.cast("double")).cast("int")


def _boxes(images: DataFrame, boxes: Column, mode: str, clip: bool = True) -> DataFrame:
    """boxes: an array of (x0, y0, x1, y1) structs in order."""
    W, H = _size()  # noqa: N806
    t = images.select("image_id", "width", "height", F.posexplode(boxes).alias("tile_id", "b"))
    x0, y0, x1, y1 = (_even(F.col(f"b.{c}")) for c in ("x0", "y0", "x1", "y1"))
    if clip:
        x0, y0, x1, y1 = F.greatest(F.lit(0), x0), F.greatest(F.lit(0), y0), F.least(W, x1), F.least(H, y1)
    return t.select("image_id", F.lit(mode).alias("mode"), "tile_id", x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"))


def _box(x0, y0, x1, y1) -> Column:
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).cast("double").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])


def _cells(n: int) -> list[tuple[int, int]]:
    return [(row, col) for row in range(n) for col in range(n)]


def whole(images: DataFrame) -> DataFrame:
    W, H = _size()  # noqa: N806
    return _boxes(images, F.array(_box(0, 0, W, H)), "whole")


def grid(images: DataFrame, n: int, overlap: float = 0.0) -> DataFrame:
    """n x n cells, each widened on all sides by a share of itself."""
    W, H = _size()  # noqa: N806
    cw, ch = W / n, H / n
    return _boxes(images, F.array(*[_box(c * cw - cw * overlap, r * ch - ch * overlap, (c + 1) * cw + cw * overlap, (r + 1) * ch + ch * overlap) for r, c in _cells(n)]), f"grid_{n}x{n}")


def integer_grid(images: DataFrame, n: int) -> DataFrame:
    """Cells of whole pixels; the last of a row or column takes the remainder."""
    W, H = _size()  # noqa: N806
    cw, ch = F.floor(W / n), F.floor(H / n)
    return _boxes(images, F.array(*[_box(c * cw, r * ch, W if c == n - 1 else (c + 1) * cw, H if r == n - 1 else (r + 1) * ch) for r, c in _cells(n)]), f"cells_{n}x{n}", clip=False)


def centred_grid(images: DataFrame, scale: float, n: int = 4) -> DataFrame:
    """n x n cells of the central part of an image at a scale, one pixel wide at least."""
    W, H = _size()  # noqa: N806
    sw, sh = _even(W * scale), _even(H * scale)
    cells = images.select("image_id", "width", "height", sw.alias("sw"), sh.alias("sh"), F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("tile_id"))
    r, c = F.floor(F.col("tile_id") / n), F.col("tile_id") % n
    side = lambda whole, part, i: _even(F.floor((whole - F.col(part)) / 2) + i * (F.col(part) / n))
    t = cells.select("image_id", F.lit(f"centred_{n}x{n}").alias("mode"), "tile_id", "width", "height", side(W, "sw", c).alias("x0"), side(H, "sh", r).alias("y0"), side(W, "sw", c + 1).alias("x1"), side(H, "sh", r + 1).alias("y1"))
    wide = lambda low, high, most: F.greatest(F.col(low) + 1, F.least(most, F.col(high))).cast("int").alias(high)
    return t.select("image_id", "mode", "tile_id", "x0", "y0", wide("x0", "x1", W), wide("y0", "y1", H))


def centre_crop(images: DataFrame, size: int) -> DataFrame:
    W, H = _size()  # noqa: N806
    s = F.least(W, H, F.lit(size))
    x, y = F.floor(W / 2) - F.floor(s / 2), F.floor(H / 2) - F.floor(s / 2)
    return _boxes(images, F.array(_box(x, y, x + s, y + s)), "centre")


def five_crop(images: DataFrame, size: int) -> DataFrame:
    W, H = _size()  # noqa: N806
    s = F.least(W, H, F.lit(size))
    x, y = F.floor(W / 2) - F.floor(s / 2), F.floor(H / 2) - F.floor(s / 2)
    return _boxes(images, F.array(_box(x, y, x + s, y + s), _box(0, 0, s, s), _box(W - s, 0, W, s), _box(0, H - s, s, H), _box(W - s, H - s, W, H)), "five_crop")


def strips(images: DataFrame, n: int, across: bool, overlap: float = 0.0) -> DataFrame:
    """n strips: across the image's width, or down its height."""
    W, H = _size()  # noqa: N806
    size = (H if across else W) / n
    edge = size * overlap
    cut = [(i * size - edge, (i + 1) * size + edge) for i in range(n)]
    return _boxes(images, F.array(*[_box(0, a, W, b) if across else _box(a, 0, b, H) for a, b in cut]), f"{'h' if across else 'v'}strips_{n}")


def _starts(dim: Column, size: int, stride: int) -> Column:
    """Starts along one side; the last tile ends at the edge."""
    last = F.greatest(dim - size, F.lit(0)).cast("int")
    steps = F.sequence(F.lit(0), last, F.lit(stride))
    return F.array_distinct(F.concat(steps, F.array(last)))


def sliding(images: DataFrame, size: int, stride: int) -> DataFrame:
    """Tiles of one size at steps of a stride; images that are no larger are taken whole."""
    W, H = _size()  # noqa: N806
    small = (W <= size) & (H <= size)
    ys, xs = _starts(H, size, stride), _starts(W, size, stride)
    boxes = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: _box(x, y, F.least(x + size, W), F.least(y + size, H)))))
    return _boxes(images, F.when(small, F.array(_box(0, 0, W, H))).otherwise(boxes), "sliding")


def tile_count(images: DataFrame, size: int, stride: int, scales: list[float]) -> DataFrame:
    """(image_id, n): how many tiles the image has at all scales."""
    W, H = _size()  # noqa: N806
    total = F.lit(0)
    for s in scales:
        w, h = F.greatest(F.lit(1), _even(W * s)), F.greatest(F.lit(1), _even(H * s))
        total = total + F.size(_starts(w, size, stride)) * F.size(_starts(h, size, stride))
    return images.select("image_id", total.cast("int").alias("n"))


def multiscale(images: DataFrame, overlap: float = 0.0, most: int | None = None) -> DataFrame:
    """The whole image, 2 x 2 and 4 x 4 cells, numbered through; the first `most` of them."""
    parts = whole(images).withColumn("o", F.lit(0)).union(grid(images, 2, overlap).withColumn("o", F.lit(1))).union(grid(images, 4, overlap).withColumn("o", F.lit(2)))
    t = parts.withColumn("tile_id", F.row_number().over(Window.partitionBy("image_id").orderBy("o", "tile_id")) - 1).drop("o")
    return t.where(F.col("tile_id") < most) if most else t


def dense(images: DataFrame, scales: tuple[int, ...], size: int = 224, stride: int = 0, with_sliding: bool = False, overlap: float = 0.0) -> DataFrame:
    """The whole image, n x n cells for each n of the scales above one, and sliding tiles if asked for, numbered through."""
    parts = [whole(images), *[grid(images, n, overlap) for n in scales if n > 1]]
    if with_sliding:
        parts.append(sliding(images, size, stride or max(1, size // 2)))
    out = parts[0].withColumn("o", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.union(p.withColumn("o", F.lit(i)))
    return out.withColumn("tile_id", F.row_number().over(Window.partitionBy("image_id").orderBy("o", "tile_id")) - 1).drop("o")


TILINGS = {"dense": dense, "whole": whole, "grid": grid, "integer_grid": integer_grid, "centred_grid": centred_grid, "centre_crop": centre_crop, "five_crop": five_crop, "strips": strips, "sliding": sliding, "multiscale": multiscale}


#: Tilings by name: from (image_id, width, height) to boxes.
TILINGS = {
    "whole": whole,
    "grid": functools.partial(grid, n=3),
    "cells": functools.partial(integer_grid, n=4),
    "centred_grid": functools.partial(centred_grid, scale=0.8),
    "centre": functools.partial(centre_crop, size=224),
    "five_crop": functools.partial(five_crop, size=448),
    "strips": functools.partial(strips, n=3, across=True),
    "sliding": functools.partial(sliding, size=448, stride=224),
    "multiscale": functools.partial(multiscale, most=6),
    "dense": functools.partial(dense, scales=(1, 2)),
}
