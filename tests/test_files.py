"""Readers, sinks, pixels and streams on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import pixels
from tesserae.sources import readers, sinks
from tesserae.streaming import telemetry
from tests.bitmaps import bmp


@pytest.fixture
def pictures(tmp_path):
    rng = np.random.default_rng(3)
    green = np.zeros((40, 60, 3))
    green[:, :30, 1] = 200
    green[:, 30:] = (200, 10, 10)
    for split, species, name, rgb in (("train", "7", "a", green), ("train", "8", "b", rng.integers(0, 255, (40, 60, 3))), ("val", "7", "c", green), ("val", "9", "d", green)):
        (tmp_path / split / species).mkdir(parents=True, exist_ok=True)
        (tmp_path / split / species / f"{name}.bmp").write_bytes(bmp(rgb))
    (tmp_path / "val" / "7" / "bad.bmp").write_bytes(b"x" * 2000)
    (tmp_path / "val" / "7" / "tiny.bmp").write_bytes(b"x")
    return tmp_path


def test_class_folders(spark, pictures):
    got = readers.class_folders(spark, str(pictures), split=True).select("split", "species_id", "image_name").collect()
    assert sorted(map(tuple, got)) == [("train", "7", "a.bmp"), ("train", "8", "b.bmp"), ("val", "7", "bad.bmp"), ("val", "7", "c.bmp"), ("val", "7", "tiny.bmp")]
    flat = readers.class_folders(spark, str(pictures / "train"))
    assert sorted(r.species_id for r in flat.collect()) == ["7", "8"]


def test_bytes_from_two_roots(spark, tmp_path):
    """A file comes from the first root that has it; shards hold the bytes."""
    for root, name, data in (("a", "7/x.jpg", b"first"), ("b", "7/x.jpg", b"second"), ("b", "8/y.jpg", b"only")):
        (tmp_path / root / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / root / name).write_bytes(data)
    rows = spark.createDataFrame([("x", "7/x.jpg", "7, 9"), ("y", "8/y.jpg", "8"), ("z", "9/z.jpg", "9")], "key string, image_path string, species_ids string")
    found = readers.with_bytes(rows, [str(tmp_path / "a"), str(tmp_path / "b")])
    sinks.write_shards(found, str(tmp_path / "shards"), 1)
    assert sorted((r.key, bytes(r.jpg), r.label) for r in spark.read.parquet(str(tmp_path / "shards")).collect()) == [("x", b"first", "7"), ("y", b"only", "8")]


def test_pixels(spark, pictures):
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(str(pictures))
    got = {r.origin.rsplit("/", 1)[1]: r for r in pixels.measure(images).collect()}
    assert sorted(got) == ["a.bmp", "b.bmp", "c.bmp", "d.bmp"]
    assert got["a.bmp"].veg == pytest.approx(0.5) and got["a.bmp"].veg_guarded == pytest.approx(0.5)
    assert got["a.bmp"].ahash == got["c.bmp"].ahash != got["b.bmp"].ahash
    assert got["b.bmp"].laplacian > got["a.bmp"].laplacian
    assert bin(int(got["a.bmp"].ahash, 16)).count("1") == 128
    near = pixels.measure(images).crossJoin(F.broadcast(pixels.measure(images).where("origin like '%a.bmp'").select(F.col("ahash").alias("h")))).where(pixels.near_hash(F.col("ahash"), F.col("h"), 10))
    assert near.count() == 3
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(pictures)).select("path", "length")
    assert sorted(r.reason for r in pixels.broken(listing, images.select("image.origin")).collect()) == ["small", "undecodable"]
    rate = pixels.skip_rate(pixels.measure(images), 1.0, 1e9).first()
    assert rate.images == 4 and rate.skipped == 1.0
    masks = images.where("image.origin like '%train/7%'").select(F.lit(1).alias("image_id"), "image")
    boxes = spark.createDataFrame([(1, 0, 0, 0, 30, 40), (1, 1, 0, 0, 60, 40)], "image_id int, tile_id int, x0 int, y0 int, x1 int, y1 int")
    assert [r.noise_fraction for r in pixels.noise_share(masks, boxes).orderBy("tile_id").collect()] == [1.0, 1.0]


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_manifest(spark, tmp_path, sep):
    (tmp_path / "m.csv").write_text(sep.join(['"Species_ID"', "'filename'", "other"]) + "\n" + sep.join(["12.0", "a.jpg", ""]) + "\n")
    df = readers.read_manifest(spark, str(tmp_path / "m.csv"))
    assert df.columns == ["species_id", "image_name", "other"]
    assert df.first().species_id == "12"


def test_months(spark, tmp_path):
    lines = ['{"species_id": "1", "months": {"1": 5}}', "{bad", '{"species_id": "2", "error": "x"}', '{"species_id": "1", "months": {"3": 2, "4": 1}}']
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    assert sorted(map(tuple, readers.month_jsonl(spark, str(tmp_path / "m.jsonl")).collect())) == [("1", 3, 2), ("1", 4, 1)]
    (tmp_path / "m.csv").write_text("species_id,m_01\n1,2\n")
    with pytest.raises(ValueError, match="m_02"):
        readers.month_csv(spark, str(tmp_path / "m.csv"))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ([0.1, 0.2], {"a": 0.1, "b": 0.2}),
        ({"thresholds": [0.1, 0.2]}, {"a": 0.1, "b": 0.2}),
        ({"0": 0.1, "1": 0.2}, {"a": 0.1, "b": 0.2}),
        ({"a": 0.1, "b": 0.2}, {"a": 0.1, "b": 0.2}),
    ],
)
def test_thresholds(spark, tmp_path, text, want):
    (tmp_path / "t.json").write_text(json.dumps(text))
    classes = spark.createDataFrame([("a", 0), ("b", 1)], "species_id string, code int")
    assert {r.species_id: r.threshold for r in readers.thresholds(spark, str(tmp_path / "t.json"), classes).collect()} == want


def test_submission(spark, tmp_path):
    p = spark.createDataFrame([("q1", 2, 5), ("q1", 1, 9)], "image_id string, rank int, species_id bigint")
    images = spark.createDataFrame([("q1",), ("q2",)], "image_id string")
    rows = sinks.submission_rows(p, images)
    assert sorted(map(tuple, rows.collect())) == [("q1", "[9, 5]"), ("q2", "[]")]
    sinks.write_submission(rows.coalesce(1), str(tmp_path / "s"))
    text = next((tmp_path / "s").glob("part-*")).read_text()
    assert '"quadrat_id","species_ids"' in text and '"q1","[9, 5]"' in text
    assert sorted(map(tuple, readers.submission(spark, str(tmp_path / "s")).collect())) == [("q1", 1, 9), ("q1", 2, 5)]


def test_shards_have_their_size(spark, tmp_path):
    t = spark.range(25).select(F.col("id").cast("string").alias("key"), F.lit(b"x").alias("jpg"), F.lit("3, 4").alias("species_ids")).coalesce(1)
    sinks.write_shards(t, str(tmp_path / "s"), 10)
    assert len(list((tmp_path / "s").glob("part-*.parquet"))) == 3
    assert {r.label for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {"3"}


def test_summaries(spark, tmp_path):
    for m in ("b", "a"):
        (tmp_path / m).mkdir()
        (tmp_path / m / "summary.json").write_text(json.dumps({"model": m, "prompt_mode": "p", "f1": 0.5}, indent=1))
    assert [r.model for r in readers.summaries(spark, str(tmp_path / "*" / "summary.json")).collect()] == ["a", "b"]


def test_event_stream(spark, tmp_path):
    folder = tmp_path / "ev"
    folder.mkdir()
    line = lambda i, ts: json.dumps({"ts": ts, "run_id": "r", "rank": 0, "world": 1, "phase": "p", "host_id": "h", "name": "step", "fields": {"step": str(i)}})
    (folder / "1.jsonl").write_text("\n".join([line(1, "2024-01-01T00:00:00Z"), "{broken", line(2, "2024-01-01T00:04:00Z")]))
    got = telemetry.drain(telemetry.latest(telemetry.read_events(spark, str(folder))), "latest_events", "complete").collect()
    assert [(r.run_id, r["rank"], r.step) for r in got] == [("r", 0, 2)]


def test_registry_keeps_the_last(spark, tmp_path):
    merge = telemetry.registry_upsert(str(tmp_path / "r"), ["run"], "at")
    merge(spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "run string, at int, status string"), 0)
    for _ in range(2):
        merge(spark.createDataFrame([("a", 2, "ready")], "run string, at int, status string"), 1)
    assert sorted(map(tuple, telemetry.registry(spark, str(tmp_path / "r"), 1).collect())) == [("a", 2, "ready"), ("b", 1, "x")]
