"""Queries that write tables which Spark derives to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import selection as K
from tesserae.functions.lineage import scratch
from tesserae.plans.priors import HIST, histogram
from tesserae.plans.registry import query, r
from tesserae.plans.scoring import images
from tesserae.plans.selecting import BEST, T, base, scored
from tesserae.plans.views import MANIFEST, manifest, table
from tesserae.sources import readers as R
from tesserae.sources import shards as X
from tesserae.sources import sinks as K2


@query("s01_read_manifest", f"WITH {MANIFEST} SELECT regexp_replace(species_id, '\\.0+$', '') AS species_id, source AS genus, count(*) AS n, count(DISTINCT image_name) AS names FROM man GROUP BY 1, 2")
def s01(spark, sf):
    out = scratch(spark, "manifest")
    m = manifest(spark, sf).select(F.col("species_id").alias("Class_ID"), F.col("source").alias("Genus_Name"), F.col("image_name").alias("filename"))
    m.write.csv(out, sep=";", header=True)
    return R.read_manifest(spark, out).groupBy("species_id", "genus").agg(F.count("*").alias("n"), F.count_distinct("image_name").alias("names"))


@query("s05_test_items", "SELECT CAST(o_orderkey AS VARCHAR) AS image_id, CAST(NULL AS VARCHAR) AS file_name, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 7 ELSE month(o_orderdate) END AS INT) AS month FROM orders")
def s05(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("Plot_ID"), F.when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))
    return R.test_items(o, month=True)


@query("s07_month_jsonl", f"WITH {HIST} SELECT CAST(species_id AS VARCHAR) AS species_id, month, n FROM hist WHERE species_id % 9 <> 0")
def s07(spark, sf):
    """Histograms as JSON lines, with errors and broken lines among them."""
    out = scratch(spark, "months")
    h = histogram(spark, sf).groupBy("species_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("month").cast("string"), "n"))).alias("months"))
    good = F.to_json(F.struct(F.col("species_id").cast("string").alias("species_id"), "months"))
    bad = F.to_json(F.struct(F.col("species_id").cast("string").alias("species_id"), F.lit("not found").alias("error")))
    lines = h.select(F.explode(F.when(F.col("species_id") % 9 == 0, F.array(bad)).otherwise(F.array(good, F.lit("{broken")))).alias("value"))
    lines.write.text(out)
    return R.month_jsonl(spark, out)


@query("s08_month_csv", f"WITH {HIST} SELECT CAST(s.species_id AS VARCHAR) AS species_id, CAST(g.m AS INT) AS month, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT species_id FROM hist) s CROSS JOIN range(1, 13) g(m) LEFT JOIN hist h ON h.species_id = s.species_id AND h.month = g.m")
def s08(spark, sf):
    out = scratch(spark, "months")
    wide = histogram(spark, sf).groupBy("species_id").pivot("month", list(range(1, 13))).sum("n").fillna(0)
    wide.select("species_id", *[F.col(str(i)).alias(f"m_{i:02d}") for i in range(1, 13)]).write.csv(out, header=True)
    return R.month_csv(spark, out)


@query("s09_species_list", "SELECT p_partkey AS species_id, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INT) AS code FROM part")
def s09(spark, sf):
    out = scratch(spark, "species")
    p = table(spark, sf, "part")
    p.select(F.concat_ws(";", F.lit("species"), F.col("p_partkey").cast("string"), F.lit("x9")).alias("value")).union(spark.range(1).select(F.lit("species_id header"))).write.text(out)
    return R.species_list(spark, out)


SUBMITTED = f"{BEST}, q AS (SELECT * FROM k WHERE rank <= 5 AND score >= {T})"


@query("s11_submission_rows", f"{SUBMITTED}, l AS (SELECT image_id, '[' || string_agg(CAST(species_id AS VARCHAR), ', ' ORDER BY rank) || ']' AS s FROM q GROUP BY 1) SELECT CAST(i.image_id AS VARCHAR) AS quadrat_id, coalesce(s, '[]') AS species_ids FROM (SELECT DISTINCT image_id FROM img) i LEFT JOIN l USING (image_id)")
def s11(spark, sf):
    return K2.submission_rows(K.cap_first(scored(spark, sf), T, 5, 0), base(spark, sf))


@query("s10_submission_round_trip", f"{SUBMITTED} SELECT CAST(image_id AS VARCHAR) AS image_id, CAST(rank AS INT) AS rank, CAST(species_id AS BIGINT) AS species_id FROM q")
def s10(spark, sf):
    out = scratch(spark, "submission")
    K2.write_submission(K2.submission_rows(K.cap_first(scored(spark, sf), T, 5, 0), base(spark, sf)), out)
    return R.submission(spark, out)


@query("s12_by_configuration", f"{BEST}, m AS (SELECT image_id, species_id, row_number() OVER (PARTITION BY image_id ORDER BY mx DESC, species_id) AS rank FROM img), u AS (SELECT 'mean' AS agg, 'top3' AS selection, image_id FROM k WHERE rank <= 3 UNION ALL SELECT 'max', 'top2', image_id FROM m WHERE rank <= 2) SELECT agg, selection, count(DISTINCT image_id) AS images, {r('count(*) / count(DISTINCT image_id)', 'mean_k')} FROM u GROUP BY 1, 2")
def s12(spark, sf):
    mx = images(spark, sf).select("image_id", "species_id", F.col("mx").alias("score"))
    rows = K.fixed_topk(scored(spark, sf), 3).select(F.lit("mean").alias("agg"), F.lit("top3").alias("selection"), "image_id", "rank", "species_id", "score")
    rows = rows.unionByName(K.fixed_topk(mx, 2).select(F.lit("max").alias("agg"), F.lit("top2").alias("selection"), "image_id", "rank", "species_id", "score"))
    return K2.write_by_configuration(rows, scratch(spark, "configurations"))


@query("s13_scored_predictions", f"{BEST} SELECT CAST(image_id AS VARCHAR) AS quadrat_id, CAST(rank AS INT) AS rank, species_id, {r('score', 'score')} FROM k WHERE rank <= 3")
def s13(spark, sf):
    out = scratch(spark, "scored")
    K2.write_columnar(K.fixed_topk(scored(spark, sf), 3).select(F.col("image_id").cast("string").alias("quadrat_id"), "rank", "species_id", "score"), out)
    return spark.read.parquet(out)


@query("s14_to_columnar", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def s14(spark, sf):
    a, b = scratch(spark, "csv"), scratch(spark, "columnar")
    table(spark, sf, "lineitem").select("l_returnflag", "l_suppkey").write.csv(a, header=True)
    K2.write_columnar(spark.read.schema("l_returnflag string, l_suppkey bigint").csv(a, header=True), b)
    return spark.read.parquet(b).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("s15_feature_shards", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def s15(spark, sf):
    out = scratch(spark, "features")
    e = table(spark, sf, "embeddings")
    e.repartition(4, "vec_id").write.parquet(out)
    return R.feature_shards(spark, out, e.count()).groupBy("label").agg(F.count("*").alias("n"))


@query("s16_merge_sorted", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status FROM orders")
def s16(spark, sf):
    out = scratch(spark, "outputs")
    table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")).repartition(5).write.csv(out, header=True)
    return K2.merge_sorted(spark, out, ["id"])


@query("s17_remaining", "SELECT o_orderkey AS image_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def s17(spark, sf):
    return R.remaining(table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id")))


@query("s18_training_shards", "SELECT CAST(l_suppkey AS VARCHAR) AS label, count(*) AS n FROM lineitem GROUP BY 1")
def s18(spark, sf):
    out = scratch(spark, "shards")
    li = table(spark, sf, "lineitem")
    rows = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), F.encode(F.col("l_orderkey").cast("string"), "UTF-8").alias("jpg"), F.concat_ws(",", F.col("l_suppkey").cast("string"), F.lit("7")).alias("species_ids"))
    K2.write_shards(rows, out, 2_000)
    return spark.read.parquet(out).groupBy("label").agg(F.count("*").alias("n"))


@query("s18_exact_shards", "SELECT key, label, shard, CAST(slot AS INT) AS slot, 'shard-' || lpad(CAST(shard AS VARCHAR), 8, '0') || '.parquet' AS file FROM (SELECT *, o // 2000 AS shard, o % 2000 AS slot FROM (SELECT l_orderkey || '-' || l_linenumber AS key, CAST(l_suppkey AS VARCHAR) AS label, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_suppkey) - 1 AS o FROM lineitem))")
def s18_exact(spark, sf):
    """Every shard but the last holds 2,000 rows; file, shard and slot of each row as read back."""
    out = scratch(spark, "exact")
    li = table(spark, sf, "lineitem")
    rows = li.select("l_orderkey", "l_linenumber", "l_suppkey", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), F.encode(F.col("l_orderkey").cast("string"), "UTF-8").alias("jpg"), F.col("l_suppkey").cast("string").alias("label"))
    X.write_exact_shards(rows, out, 2_000, "l_orderkey", "l_linenumber", "l_suppkey")
    return X.read_exact_shards(spark, out).select("key", "label", "shard", "slot", F.col("_metadata.file_name").alias("file"))


@query("s06_observations", "SELECT CAST(o_orderkey AS VARCHAR) AS image_id, o_orderpriority AS file_name, CAST(CASE WHEN o_orderkey % 5 < 2 THEN 7 ELSE month(o_orderdate) END AS INT) AS month FROM orders")
def s06(spark, sf):
    """An observation list with dates as ISO times, some broken or missing: these are of July."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    date = F.when(F.col("o_orderkey") % 5 == 0, "not a date").when(F.col("o_orderkey") % 5 == 1, F.lit(None)).when(F.col("o_orderkey") % 2 == 0, F.concat(day, F.lit("T10:30:00"))).otherwise(day)
    return R.test_items(table(spark, sf, "orders").select(F.col("o_orderkey").alias("observation_id"), F.col("o_orderpriority").alias("filename"), date.alias("date")), month=True)


@query("s19_validation_extract", "SELECT o_orderkey AS image_id, o_custkey AS species_id FROM orders ORDER BY 1 LIMIT 50")
def s19(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("species_id"), F.lit("x").alias("image_path"))
    return K2.validation_extract(o, "o_orderkey", 50)[0]


@query("s20_summaries", f"SELECT event_type AS model, 'b' AS prompt_mode, {r('avg(value)', 'f1')} FROM events GROUP BY 1")
def s20(spark, sf):
    out = scratch(spark, "summaries")
    table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.lit("b").alias("prompt_mode"), F.avg("value").alias("f1")).write.json(out)
    return spark.read.json(out).select("model", "prompt_mode", "f1").orderBy("model", "prompt_mode")


@query("s21_thresholds", f"SELECT p_brand AS species_id, {r('max(p_size) / 100.0', 'threshold')} FROM part GROUP BY 1")
def s21(spark, sf):
    """A threshold for each class; the file holds one object of all classes."""
    out = scratch(spark, "thresholds")
    per = table(spark, sf, "part").groupBy("p_brand").agg((F.max("p_size") / 100.0).alias("t"))
    per.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("p_brand", "t"))).alias("thresholds"))).alias("value")).write.text(out)
    return R.thresholds(spark, out)


def _folders(spark, sf) -> str:
    """One file for each split and class, in folders of their names; class 9 has no training file."""
    out = scratch(spark, "folders")
    e = table(spark, sf, "embeddings").select(F.when((F.col("label") == 9) | (F.col("vec_id") % 10 == 0), "val").otherwise("train").alias("split"), F.col("label").alias("species"), "vec_id", "embedding")
    e.repartition("split", "species").write.partitionBy("split", "species").parquet(out)
    return out


@query("s03_class_folders", "SELECT CAST(label AS VARCHAR) AS species_id, count(*) AS files FROM (SELECT DISTINCT label, label = 9 OR vec_id % 10 = 0 AS val FROM embeddings) WHERE NOT val GROUP BY 1")
def s03(spark, sf):
    """Files of one split's folders, by the folder's name."""
    found = R.class_folders(spark, f"{_folders(spark, sf)}/split=train")
    return found.where("image_name like '%.parquet' and length > 0").groupBy("species_id").agg(F.count("*").alias("files"))


@query("s04_split_folders", "SELECT split, CAST(label AS VARCHAR) AS species_id, count(*) AS files FROM (SELECT DISTINCT label, CASE WHEN label = 9 OR vec_id % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM embeddings) WHERE label <> 9 GROUP BY 1, 2")
def s04(spark, sf):
    """The same of all splits; classes are those of the training folders."""
    found = R.class_folders(spark, _folders(spark, sf), split=True)
    return found.where("image_name like '%.parquet' and length > 0").groupBy("split", "species_id").agg(F.count("*").alias("files"))
