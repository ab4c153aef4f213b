"""Hamming joins against all pairs, and snapshots that grow by what is new."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import image_hashes as H
from tesserae.operators import pixels
from tests.bitmaps import bmp


def hashes(seed, n=160):
    """Random hashes, near copies of some, and crowds that agree in most of their chunks."""
    rng = random.Random(seed)
    out = [rng.getrandbits(256) for _ in range(n)]
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(256), k))
    out += [flip(out[i % 40], rng.randint(0, 14)) for i in range(n)]
    out += [flip(0, rng.randint(0, 12)) for _ in range(60)] + [0, 0, 2**256 - 1]
    return [f"{x:064x}" for x in out]


def brute(left, right, bits):
    pairs = {(a, b) for a in left for b in right}
    return sorted((a, b, d) for a, b in pairs if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= bits)


@pytest.mark.parametrize(("bits", "slack", "crowded"), [(0, 3, 250_000), (8, 3, 250_000), (10, 3, 5), (10, 0, 5), (12, 2, 50)])
def test_near_hashes(spark, monkeypatch, bits, slack, crowded):
    monkeypatch.setattr(H, "BLOCK", 7)
    left, right = hashes(1), hashes(2) + hashes(1)[:200]
    frame = lambda x: spark.createDataFrame([(h,) for h in [*x, None]], "h string")
    got = H.near_hashes(frame(left), frame(right), bits, slack=slack, crowded=crowded)
    assert sorted(map(tuple, got.collect())) == brute(left, right, bits)
    assert H.near_hashes(frame([]), frame(right), bits, slack=slack).count() == 0


@pytest.mark.parametrize(("side", "bits"), [(8, 24), (2, 24), (16, 10)])
def test_enlarged_pictures(spark, monkeypatch, side, bits):
    """Hashes of pictures of few pixels have each of their bits many times; the tables' entries do not grow with the copies of a bit."""
    made, keep = [0], H.cut
    monkeypatch.setattr(H, "cut", lambda df: made.append((out := keep(df)).count()) or out)
    rng, k = random.Random(side), 16 // side

    def enlarged(n):
        base = rng.getrandbits(side * side)
        pixels = [base ^ sum(1 << rng.randrange(side * side) for _ in range(rng.randint(0, 8))) if i % 2 else rng.getrandbits(side * side) for i in range(n)]
        at = [(y // k) * side + x // k for y in range(16) for x in range(16)]
        return [f"{int(''.join(str(p >> i & 1) for i in at), 2):064x}" for p in pixels]

    left, right = enlarged(300), enlarged(300)
    frame = lambda x: spark.createDataFrame([(h,) for h in x], "h string")
    got = H.near_hashes(frame(left), frame([*right, *left[:50]]), bits, crowded=100)
    assert sorted(map(tuple, got.collect())) == brute(left, [*right, *left[:50]], bits)
    assert sum(made) < 300 * 1000


def test_too_many_bits(spark):
    with pytest.raises(ValueError, match="do not fit"):
        H.near_hashes(spark.createDataFrame([("0",)], "h string"), spark.createDataFrame([("0",)], "h string"), 62)


def test_near_images_count_copies(spark):
    zero, one, far = "0" * 64, "0" * 63 + "1", "f" * 64
    old = spark.createDataFrame([("a", zero), ("b", zero), ("c", one), ("d", None)], "path string, ahash string")
    new = spark.createDataFrame([("x", one), ("y", far), ("z", None), ("w", zero), ("w", zero)], "path string, ahash string")
    got = sorted(((r.path, r.n_near, r.distance, r.nearest) for r in H.near_images(new, old, 2).collect()), key=str)
    assert got == [("w", 3, 0, "a"), ("w", 3, 0, "a"), ("x", 3, 0, "c"), ("y", 0, None, None), ("z", 0, None, None)]


def test_second_batch_hashes_only_what_is_new(spark, tmp_path):
    seen = []

    def hashed(new):
        seen.append(sorted((r.path, r.length) for r in new.collect()))
        return new.select("path", "length", F.sha2("path", 256).alias("sha256"), F.lit(None).cast("string").alias("ahash"), F.lit(False).alias("ok"), F.lit("x").alias("error"))

    rows = lambda x: spark.createDataFrame(x, "path string, length bigint")
    out = str(tmp_path / "snapshot")
    H.hash_new(rows([("a", 1), ("b", 2), ("b", 2)]), out, 1, hashed)
    H.hash_new(rows([("a", 1), ("b", 3), ("c", 4)]), out, 2, hashed)
    H.hash_new(rows([("a", 1), ("b", 3), ("c", 4)]), out, 3, hashed)
    assert seen == [[("a", 1), ("b", 2)], [("b", 3), ("c", 4)], []]
    assert sorted((r.path, r.length, r.batch) for r in H.snapshot(spark, out).collect()) == [("a", 1, 1), ("b", 3, 2), ("c", 4, 2)]


def test_files(spark, tmp_path, monkeypatch):
    """New files are read in bounded parts; a file that changes its length is read again; one that is no image has no hash."""
    monkeypatch.setattr(H, "FILES", 2)
    rng = np.random.default_rng(1)
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.bmp").write_bytes(bmp(rng.integers(0, 255, (32, 32, 3))))
    (tmp_path / "in" / "bad.bmp").write_bytes(b"no image" * 9)
    out = str(tmp_path / "snapshot")
    assert H.hash_new_files(spark, str(tmp_path / "in"), out) == 4
    assert H.hash_new_files(spark, str(tmp_path / "in"), out) == 0
    (tmp_path / "in" / "new.bmp").write_bytes(bmp(rng.integers(0, 255, (20, 20, 3))))
    (tmp_path / "in" / "0.bmp").write_bytes(bmp(rng.integers(0, 255, (16, 16, 3))))
    assert H.hash_new_files(spark, str(tmp_path / "in"), out) == 2
    found = {r.path.rsplit("/", 1)[1]: r for r in H.snapshot(spark, out).collect()}
    assert {n: r.ok for n, r in found.items()} == {"0.bmp": True, "1.bmp": True, "2.bmp": True, "new.bmp": True, "bad.bmp": False}
    assert found["bad.bmp"].error == "undecodable" and found["0.bmp"].batch > found["1.bmp"].batch
    images = spark.read.format("image").option("dropInvalid", True).load(str(tmp_path / "in"))
    assert {r.origin.rsplit("/", 1)[1]: r.ahash for r in pixels.measure(images).collect()} == {n: r.ahash for n, r in found.items() if r.ok}
