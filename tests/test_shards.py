"""Ordinals over tasks, and shards of an exact size."""

import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tesserae.functions.ordinals import numbered
from tesserae.operators import curation, metrics
from tesserae.sources import readers, shards


def rows(spark, n, parts=5):
    return spark.range(n).select((F.col("id") * 7919 % 1009).alias("k"), "id").repartition(parts)


@pytest.mark.parametrize("n", [0, 1, 3, 1000])
def test_ordinals_follow_the_order(spark, n):
    got = numbered(rows(spark, n), F.desc("k"), "id").collect()
    want = {(k, i): o for o, (k, i) in enumerate(sorted(((i * 7919 % 1009, i) for i in range(n)), key=lambda x: (-x[0], x[1])))}
    assert {(r.k, r.id): r.ordinal for r in got} == want


def test_no_window_over_all_rows(spark, tmp_path):
    (tmp_path / "species.txt").write_text("id\n7;x\n3;y\n")
    c = spark.createDataFrame([("b", 3), ("a", 2), ("", 9), (None, 9)], "species_id string, n int")
    image = spark.createDataFrame([(1, "a")], "image_id int, species_id string")
    made = [curation.encode(c, "species_id"), readers.species_list(spark, str(tmp_path / "species.txt")), metrics.head_tail(image, image, c)]
    assert [tuple(r) for r in made[0].orderBy("code").collect()] == [("a", 0), ("b", 1)]
    assert [tuple(r) for r in made[1].orderBy("code").collect()] == [(3, 0), (7, 1)]
    for df in made:
        assert "Window" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize(("n", "size"), [(0, 10), (9, 10), (10, 10), (1003, 100), (57, 1)])
def test_shards_are_exact(spark, tmp_path, n, size):
    out = str(tmp_path / "out")
    shards.write_exact_shards(rows(spark, n), out, size, "k", "id")
    index = json.loads((tmp_path / "out" / shards.INDEX).read_text())
    assert index == {"size": size, "rows": [size] * (n // size) + ([n % size] if n % size else [])}
    want = sorted((i * 7919 % 1009, i) for i in range(n))
    for s, count in enumerate(index["rows"]):
        t = pq.read_table(tmp_path / "out" / shards.NAME.format(s))
        assert t.num_rows == count and t.column("slot").to_pylist() == list(range(count))
        assert list(zip(t.column("k").to_pylist(), t.column("id").to_pylist(), strict=True)) == want[s * size : s * size + count]
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_staging")]
    if n:
        assert shards.read_exact_shards(spark, out).count() == n


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    """A task that fails in the middle, and shards that are not whole, put no file in place."""
    out = str(tmp_path / "out")
    bad = rows(spark, 500).withColumn("x", F.when(F.col("id") == 321, F.raise_error(F.lit("broken row"))).otherwise(F.lit("")))
    spark.dataSource.register(shards.ExactShards)
    dealt = shards.place_rows(rows(spark, 500), 100, "k", "id").join(bad.select("id", "x"), "id").repartition("shard").sortWithinPartitions("shard", "slot")
    with pytest.raises(Exception, match="broken row"):
        dealt.write.format("exact_shards").option("path", out).option("size", 100).mode("append").save()
    whole = shards.place_rows(rows(spark, 500), 100, "k", "id").where("id <> 17").repartition("shard").sortWithinPartitions("shard", "slot")
    with pytest.raises(Exception, match="not whole"):
        whole.write.format("exact_shards").option("path", out).option("size", 100).mode("append").save()
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
    with pytest.raises(ValueError, match="no committed shards"):
        shards.read_exact_shards(spark, out)


def test_written_shards_are_not_lost(spark, tmp_path):
    out = str(tmp_path / "out")
    shards.write_exact_shards(rows(spark, 30), out, 10, "id")
    with pytest.raises(Exception, match="already has shards"):
        shards.write_exact_shards(rows(spark, 5), out, 10, "id")
    assert shards.read_exact_shards(spark, out).count() == 30
    shards.write_exact_shards(rows(spark, 5), out, 10, "id", overwrite=True)
    assert shards.read_exact_shards(spark, out).count() == 5
    with pytest.raises(ValueError, match="one row"):
        shards.place_rows(rows(spark, 5), 0, "id")
