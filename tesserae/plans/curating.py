"""Manifest queries over line items, parts, orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions.columns import norm_species_id
from tesserae.operators import curation as C
from tesserae.plans.registry import query, r
from tesserae.plans.views import MANIFEST, manifest, table

W = f"WITH {MANIFEST}"
NID = "regexp_replace(species_id, '\\.0+$', '')"
ROW = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(CAST(l_extendedprice * 100 AS BIGINT) AS VARCHAR)"
LI = f"li AS (SELECT *, {ROW} AS key FROM lineitem)"


def lines(spark, sf):
    """Line items with a key of their own."""
    li = table(spark, sf, "lineitem")
    return li.withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")))


@query("s01_norm_species", f"{W} SELECT source, {NID} AS sid, count(*) AS n FROM man GROUP BY 1, 2")
def s01(spark, sf):
    return manifest(spark, sf).groupBy("source", norm_species_id("species_id").alias("sid")).agg(F.count("*").alias("n"))


@query("s02_dual_column", f"{W} SELECT coalesce(CASE WHEN license = 'F' THEN species_id END, image_name, '') AS v, count(*) AS n FROM man GROUP BY 1")
def s02(spark, sf):
    return manifest(spark, sf).groupBy(F.coalesce(F.when(F.col("license") == "F", F.col("species_id")), F.col("image_name"), F.lit("")).alias("v")).agg(F.count("*").alias("n"))


@query("p01_align", "SELECT p_brand AS genus, p_type AS family, CAST(NULL AS VARCHAR) AS \"order\", count(*) AS n FROM part GROUP BY 1, 2")
def p01(spark, sf):
    t = C.align(table(spark, sf, "part").select(F.col("p_brand").alias("genus"), F.col("p_type").alias("family")), ["genus", "family", "order"])
    return t.groupBy("genus", "family", "order").agg(F.count("*").alias("n"))


@query("p02_resolve", "SELECT p_partkey AS species_id, p_brand AS genus, p_type AS family FROM part")
def p02(spark, sf):
    return C.resolve(table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), {"species_id": ["P_PARTKEY"], "genus": ["genus_name", "P_Brand"], "family": ["p_type"]})


@query("p03_image_path", f"{W} SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN image_path ELSE 'root/' || species_id || '/' || image_name END AS path FROM man")
def p03(spark, sf):
    m = manifest(spark, sf)
    own = F.when(F.col("l_linenumber") % 2 == 0, F.col("image_path")).otherwise(F.lit("  "))
    return m.select(C.image_path(own, "root", F.col("species_id"), F.col("image_name")).alias("path")).distinct()


@query("p04_relative_path", f"{W} SELECT DISTINCT '../../new/' || image_path AS path FROM man")
def p04(spark, sf):
    return manifest(spark, sf).select(C.relative_path(F.col("image_path"), "/data/new", "/data/old/deep").alias("path")).distinct()


@query("p05_padded_dir", "SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS dir FROM part")
def p05(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.padded_dir(F.col("p_partkey"), 6).alias("dir"))


@query("p06_clean_space", "SELECT c_custkey, nullif(CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name || ' ' || c_mktsegment END, '') AS t FROM customer")
def p06(spark, sf):
    t = F.when(F.col("c_custkey") % 5 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit(" \t\n "), F.col("c_mktsegment"), F.lit(" ")))
    return table(spark, sf, "customer").select("c_custkey", C.clean_space(t).alias("t"))


@query("p07_clean_name", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE upper(substr(p_name, 1, 1)) || substr(p_name, 2) END AS n FROM part")
def p07(spark, sf):
    raw = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substr(p_name, 2)"), F.lit(" (L.) Mill."))
    return table(spark, sf, "part").select("p_partkey", C.clean_name(F.when(F.col("p_size") % 3 == 0, F.col("p_name")), raw).alias("n"))


@query("p08_binomial", "SELECT p_partkey, p_name AS n FROM part")
def p08(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.binomial(F.concat(F.col("p_name"), F.lit("  Auth. ex Other"))).alias("n"))


@query("p09_clean_list", "SELECT p_partkey, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' | ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS l, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) AS f FROM part")
def p09(spark, sf):
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    items = C.clean_list(F.concat_ws("|", a, F.lit("  "), b, F.upper(a), F.concat(F.lit(" "), b)), sentence=True)
    return table(spark, sf, "part").select("p_partkey", F.array_join(items, " | ").alias("l"), items[0].alias("f"))


@query("p10_prompts", "SELECT p_partkey, 'a photo of ' || p_name || '; ' || p_name || ', a plant' AS p, CAST(2 AS INT) AS n FROM part")
def p10(spark, sf):
    t = C.prompts(table(spark, sf, "part"), ["a photo of {}", "{}, a plant", "A photo of {}"], F.array("p_name", F.upper("p_name")), 2)
    return t.select("p_partkey", F.array_join("prompts", "; ").alias("p"), F.size("prompts").alias("n"))


@query("p11_medium_url", "SELECT p_partkey, 'http://h/' || p_partkey || '/medium.jpg' AS u FROM part")
def p11(spark, sf):
    size = F.when(F.col("p_partkey") % 2 == 0, "original").otherwise("large")
    return table(spark, sf, "part").select("p_partkey", C.medium_url(F.concat(F.lit("http://h/"), F.col("p_partkey"), F.lit("/"), size, F.lit(".jpg"))).alias("u"))


@query("p12_repair_number", f"SELECT event_id, {r('CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END', 'v')} FROM events")
def p12(spark, sf):
    t = F.when(F.col("event_id") % 7 == 0, F.lit("broken")).otherwise(F.concat(F.lit("tensor("), F.col("value").cast("string"), F.lit(")")))
    return table(spark, sf, "events").select("event_id", C.repair_number(t).alias("v"))


@query("p13_repair_submission", "SELECT o_orderkey, '[' || o_orderkey || ', ' || o_custkey || ']' AS s FROM orders")
def p13(spark, sf):
    broken = F.concat(F.lit("[["), F.col("o_orderkey"), F.lit(" ,"), F.col("o_custkey"), F.lit(",]"))
    return table(spark, sf, "orders").select("o_orderkey", C.listed(C.ids_in(broken)).alias("s"))


@query("p14_only_digits", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS s FROM orders")
def p14(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(C.only_digits(F.array("o_orderpriority", F.col("o_custkey").cast("string"), "o_orderstatus")), ",").alias("s"))


@query("p15_confidence", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE 1 - l_discount >= 0.95 GROUP BY 1")
def p15(spark, sf):
    return table(spark, sf, "lineitem").where(1 - F.col("l_discount") >= 0.95).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("p16_drop_and_union", "SELECT s, count(*) AS n FROM (SELECT p_brand AS s FROM part WHERE NOT starts_with(p_brand, 'Brand#1') UNION ALL SELECT c_mktsegment FROM customer) GROUP BY 1")
def p16(spark, sf):
    kept = table(spark, sf, "part").where(~F.col("p_brand").startswith("Brand#1")).select(F.col("p_brand").alias("s"))
    return kept.unionByName(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("s"))).groupBy("s").agg(F.count("*").alias("n"))


@query("p17_traits", "SELECT p_partkey, CAST(coalesce(list_position(['ring', 'bolt', 'widget'], split_part(p_name, ' ', 2)), 0) - 1 AS INT) AS t FROM part")
def p17(spark, sf):
    """The JSON trait, or the first word of the vocabulary that the raw text holds; -1 without."""
    words = F.array(*[F.lit(w) for w in ("ring", "bolt", "widget")])
    raw = F.when(F.col("p_size") % 2 == 0, F.to_json(F.struct(F.split("p_name", " ")[1].alias("trait")))).otherwise(F.concat(F.lit("it is a "), F.col("p_name")))
    word = F.get(F.filter(words, lambda w: F.col("raw").contains(w)), F.lit(0))
    t = table(spark, sf, "part").withColumn("raw", raw).withColumn("trait", F.when(F.col("raw").startswith("{"), F.get_json_object("raw", "$.trait")).otherwise(word))
    return t.select("p_partkey", (F.coalesce(F.array_position(words, F.col("trait")), F.lit(0)) - 1).cast("int").alias("t"))


@query("p18_mask", f"SELECT l_returnflag, {r('sum(CASE WHEN l_discount >= 0.05 THEN l_discount ELSE 0 END)', 's')} FROM lineitem GROUP BY 1")
def p18(spark, sf):
    d = F.col("l_discount")
    return table(spark, sf, "lineitem").select("l_returnflag", F.when(d >= 0.05, d).otherwise(0.0).alias("d")).groupBy("l_returnflag").agg(F.sum("d").alias("s"))


def quadrat():
    return F.concat(F.lit("plot-"), F.col("o_custkey"), F.lit("-"), F.date_format("o_orderdate", "yyyyMMdd"))



@query("p19_plot_and_date", "SELECT o_orderkey, 'plot-' || o_custkey AS plot, CAST(o_orderdate AS DATE) AS day FROM orders")
def p19(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.plot_of(quadrat()).alias("plot"), C.date_of(quadrat()).alias("day"))


@query("p20_day_of_year", "SELECT o_orderkey, CAST(least(dayofyear(o_orderdate), 365) AS INT) AS d FROM orders")
def p20(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.day_of_year(F.concat(F.lit("x99999999-"), quadrat())).cast("int").alias("d"))


@query("p21_local_path", "SELECT p_partkey, '/mnt/d/img/' || p_partkey || '.jpg' AS p FROM part")
def p21(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.local_path(F.concat(F.lit("D:\\img\\"), F.col("p_partkey"), F.lit(".jpg"))).alias("p"))


@query("p22_path_registry", f"{W} SELECT count(DISTINCT image_path) AS n FROM man")
def p22(spark, sf):
    return manifest(spark, sf).select(F.xxhash64("image_path").alias("h")).dropDuplicates(["h"]).agg(F.count("*").alias("n"))


@query("j01_fill_taxonomy", "SELECT l_returnflag, coalesce(CASE WHEN l_linenumber = 1 THEN 'own' END, p_brand) AS genus, count(*) AS n FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def j01(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_partkey").alias("k"), F.when(F.col("l_linenumber") == 1, "own").alias("genus"))
    tax = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("genus"))
    return C.fill_taxonomy(li, tax, "k", ["genus"]).groupBy("l_returnflag", "genus").agg(F.count("*").alias("n"))


@query("j02_first_per_species", "SELECT c_nationkey, min_by(c_mktsegment, c_custkey) AS segment, count(*) AS n FROM customer GROUP BY 1")
def j02(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.min_by("c_mktsegment", "c_custkey").alias("segment"), F.count("*").alias("n"))


@query("j03_missing_by_split", "SELECT l_returnflag AS split, count(*) AS n, count(*) FILTER (p_partkey IS NULL) AS missing FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey GROUP BY 1")
def j03(spark, sf):
    p = table(spark, sf, "part").where("p_size > 10").select("p_partkey")
    t = table(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    return t.groupBy(F.col("l_returnflag").alias("split")).agg(F.count("*").alias("n"), F.count(F.when(F.col("p_partkey").isNull(), 1)).alias("missing"))


@query("j04_species_in_list", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def j04(spark, sf):
    s = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf, "lineitem").join(s, "l_suppkey", "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("n"))


HASHES = "old AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 2 = 0), new AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 2 = 1)"


def hashes(spark, sf, rest):
    return table(spark, sf, "documents").where(F.col("doc_id") % 2 == rest).select("doc_id", F.md5("text").alias("h"))


@query("j06_hash_overlap", f"WITH {HASHES} SELECT 'new_in_old' AS kind, count(*) AS n FROM documents WHERE doc_id % 2 = 1 AND md5(text) IN (FROM old) UNION ALL SELECT 'new_not_in_old', count(*) FROM documents WHERE doc_id % 2 = 1 AND md5(text) NOT IN (FROM old) UNION ALL SELECT 'old_in_new', count(*) FROM documents WHERE doc_id % 2 = 0 AND md5(text) IN (FROM new)")
def j06(spark, sf):
    old, new = hashes(spark, sf, 0), hashes(spark, sf, 1)
    parts = (("new_in_old", new.join(old.select("h"), "h", "left_semi")), ("new_not_in_old", new.join(old.select("h"), "h", "left_anti")), ("old_in_new", old.join(new.select("h"), "h", "left_semi")))
    out = [d.agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, d in parts]
    return out[0].union(out[1]).union(out[2])


@query("j07_matched_pairs", "SELECT a.doc_id AS id_new, b.doc_id AS id_old FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 2 = 1) a LEFT JOIN (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 2 = 0) b USING (h)")
def j07(spark, sf):
    """Fan-out is asked for: every new image with every old one of the same bytes."""
    old, new = hashes(spark, sf, 0).toDF("id_old", "h"), hashes(spark, sf, 1).toDF("id_new", "h")
    return new.join(old, "h", "left").select("id_new", "id_old")


@query("u06_hash_sets", f"WITH {HASHES} SELECT (SELECT count(*) FROM (FROM old INTERSECT FROM new)) AS both, (SELECT count(*) FROM (FROM old EXCEPT FROM new)) AS only_old, (SELECT count(*) FROM (FROM new EXCEPT FROM old)) AS only_new")
def u06(spark, sf):
    h = hashes(spark, sf, 0).select("h", F.lit(1).alias("o"), F.lit(0).alias("n")).union(hashes(spark, sf, 1).select("h", F.lit(0), F.lit(1)))
    s = h.groupBy("h").agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return s.agg(F.count(F.when(F.col("o") + F.col("n") == 2, 1)).alias("both"), F.count(F.when(F.col("o") > F.col("n"), 1)).alias("only_old"), F.count(F.when(F.col("n") > F.col("o"), 1)).alias("only_new"))


@query("j09_submission_baseline", "SELECT o_orderkey, CASE WHEN a = b THEN 1 ELSE 0 END AS same FROM (SELECT o_orderkey, o_custkey % 3 AS a FROM orders) JOIN (SELECT o_orderkey, o_orderkey % 3 AS b FROM orders WHERE o_orderstatus <> 'P') USING (o_orderkey)")
def j09(spark, sf):
    o = table(spark, sf, "orders")
    a, b = o.select("o_orderkey", (F.col("o_custkey") % 3).alias("a")), o.where("o_orderstatus <> 'P'").select("o_orderkey", (F.col("o_orderkey") % 3).alias("b"))
    return a.join(b, "o_orderkey").select("o_orderkey", (F.col("a") == F.col("b")).cast("int").alias("same"))


@query("j11_truth_sets", "SELECT o_orderkey, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_discount > 0.06 GROUP BY 1) ON l_orderkey = o_orderkey")
def j11(spark, sf):
    t = table(spark, sf, "lineitem").where("l_discount > 0.06").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("s"))
    return table(spark, sf, "orders").join(t, "o_orderkey", "left").select("o_orderkey", F.size(F.coalesce("s", F.array().cast("array<bigint>"))).cast("bigint").alias("n"))


@query("a01_count_bins", "SELECT CAST(CASE WHEN n <= 1 THEN 1 WHEN n <= 2 THEN 2 WHEN n <= 5 THEN 5 WHEN n <= 10 THEN 10 WHEN n <= 50 THEN 50 ELSE -1 END AS INT) AS bin, count(*) AS n_groups FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def a01(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return C.count_stats(n, [1, 2, 5, 10, 50])


@query("a01_count_stats", f"SELECT {r('median(n)', 'median')}, {r('avg(n)', 'mean')}, max(n) AS max FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)")
def a01b(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return n.agg(F.median("n").alias("median"), F.avg("n").alias("mean"), F.max("n").alias("max"))


@query("a02_multilabel_counts", "SELECT s, count(*) AS n FROM (SELECT unnest(string_split(l, ',')) AS s FROM (SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',') AS l FROM lineitem GROUP BY 1)) GROUP BY 1")
def a02(spark, sf):
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.col("l_suppkey").cast("string")), ",").alias("l"))
    return lists.select(F.explode(F.split("l", ",")).alias("s")).groupBy("s").agg(F.count("*").alias("n"))


@query("a03_classes", "SELECT DISTINCT p_brand AS c FROM part")
def a03(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("c")).distinct()


@query("a04_encode", "SELECT p_brand AS value, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INT) AS code FROM (SELECT DISTINCT p_brand FROM part)")
def a04(spark, sf):
    return C.encode(table(spark, sf, "part"), "p_brand")


@query("a05_apply_code", "SELECT code, count(*) AS n FROM (SELECT CASE WHEN p_size % 4 = 0 THEN CAST(-1 AS INT) ELSE CAST(c AS INT) END AS code FROM part JOIN (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS c FROM (SELECT DISTINCT p_type FROM part)) USING (p_type)) GROUP BY 1")
def a05(spark, sf):
    p = table(spark, sf, "part")
    return C.apply_code(p.withColumn("t", F.when(F.col("p_size") % 4 != 0, F.col("p_type"))), C.encode(p, "p_type"), "t", "code").groupBy("code").agg(F.count("*").alias("n"))


@query("a06_coverage", f"SELECT c AS \"column\", filled, {r('filled / n', 'share')}, n_distinct FROM (SELECT 'p_brand' AS c, count(*) AS n, count(p_brand) AS filled, count(DISTINCT p_brand) AS n_distinct FROM part UNION ALL SELECT 'half', count(*), count(*) FILTER (p_size % 2 = 0), count(DISTINCT CASE WHEN p_size % 2 = 0 THEN p_type END) FROM part)")
def a06(spark, sf):
    return C.coverage(table(spark, sf, "part").withColumn("half", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(" ")), ["p_brand", "half"])


@query("a07_lookup", "SELECT l_suppkey, count(*) AS image_count, count(DISTINCT l_orderkey) AS n_obs, string_agg(DISTINCT l_returnflag, ' | ' ORDER BY l_returnflag) AS organs FROM lineitem GROUP BY 1")
def a07(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("image_count"), F.count_distinct("l_orderkey").alias("n_obs"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), " | ").alias("organs"))


@query("a08_per_source", "SELECT l_returnflag AS source, count(*) AS n, count(DISTINCT l_partkey) AS n_species FROM lineitem GROUP BY 1")
def a08(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("source")).agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("n_species"))


@query("a09_head_mass", f"WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT n, row_number() OVER (ORDER BY n DESC, l_partkey) AS i, count(*) OVER () AS c FROM n) SELECT {r('sum(CASE WHEN i <= floor(c * 0.1) THEN n ELSE 0 END) / sum(n)', 'share')} FROM o")
def a09(spark, sf):
    """Shares come from counts of counts, which are few: no window over all classes."""
    n = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    of = n.groupBy("n").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy(F.desc("n"))))
    t = of.crossJoin(F.broadcast(n.agg(F.floor(F.count("*") * 0.1).alias("head"), F.sum("n").alias("all"))))
    taken = F.greatest(F.lit(0), F.least(F.col("c"), F.col("head") - (F.col("upto") - F.col("c"))))
    return t.agg((F.sum(taken * F.col("n")) / F.first("all")).alias("share"))


@query("a10_coverage_quantiles", "WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT " + ", ".join(r(f"quantile_cont(n, {q})", f"p{int(q * 100)}") for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + f", {r('avg(CASE WHEN n >= 30 THEN 1.0 ELSE 0 END)', 'over_30')} FROM n")
def a10(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return n.agg(*[F.percentile("n", F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.1, 0.25, 0.5, 0.75, 0.9)], F.avg((F.col("n") >= 30).cast("int")).alias("over_30"))


@query("a11_cap_counts", "SELECT l_suppkey, count(*) AS before, least(count(*), 40) AS after FROM lineitem GROUP BY 1")
def a11(spark, sf):
    li = lines(spark, sf)
    kept = C.cap(li, "l_suppkey", 40, "key").groupBy("l_suppkey").agg(F.count("*").alias("after"))
    return li.groupBy("l_suppkey").agg(F.count("*").alias("before")).join(kept, "l_suppkey")


@query("a12_mode", "WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_linenumber) AS i FROM c) SELECT l_suppkey, l_linenumber FROM o WHERE i = 1")
def a12(spark, sf):
    return C.mode_by(table(spark, sf, "lineitem"), ["l_suppkey"], "l_linenumber")


@query("a13_trait_audit", "SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 11 <> 0) AS valid, count(*) FILTER (event_id % 11 = 0) AS corrupt FROM events GROUP BY 1")
def a13(spark, sf):
    props = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    t = table(spark, sf, "events").withColumn("ok", F.try_parse_json(props).isNotNull())
    return t.groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.when(F.col("ok"), 1)).alias("valid"), F.count(F.when(~F.col("ok"), 1)).alias("corrupt"))


@query("a14_number_audit", f"SELECT count(*) AS n, count(*) FILTER (event_id % 13 = 0) AS nans, {r('min(CASE WHEN event_id % 13 <> 0 THEN value END)', 'low')}, {r('max(CASE WHEN event_id % 13 <> 0 THEN value END)', 'high')} FROM events")
def a14(spark, sf):
    v = F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    t = table(spark, sf, "events").select(v.alias("v"))
    return t.agg(F.count("*").alias("n"), F.count(F.when(F.isnan("v"), 1)).alias("nans"), F.min(F.when(~F.isnan("v"), F.col("v"))).alias("low"), F.max(F.when(~F.isnan("v"), F.col("v"))).alias("high"))


@query("a15_class_overlap", "WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R') SELECT (SELECT count(*) FROM a) AS train, (SELECT count(*) FROM b) AS val, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS both")
def a15(spark, sf):
    t = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max((F.col("l_returnflag") == "A").cast("int")).alias("a"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("b"))
    return t.agg(F.sum("a").alias("train"), F.sum("b").alias("val"), F.sum(F.col("a") * F.col("b")).alias("both"))


@query("a16_prediction_counts", f"SELECT {r('avg(n)', 'mean')}, {r('median(n)', 'median')}, min(n) AS low, max(n) AS high FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def a16(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.size(F.collect_list("l_suppkey")).cast("bigint").alias("n"))
    return n.agg(F.avg("n").alias("mean"), F.median("n").alias("median"), F.min("n").alias("low"), F.max("n").alias("high"))


@query("a17_submission_audit", f"WITH s AS (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber <= 2), t AS (SELECT l_suppkey, count(*) AS n FROM s GROUP BY 1) SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM s GROUP BY 1 HAVING count(*) > 2)) AS repeated, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM s)) AS missing, (SELECT count(DISTINCT l_suppkey) FROM s) AS n_species, {r('(SELECT sum(n) FROM (SELECT n FROM t ORDER BY n DESC LIMIT 5)) / (SELECT sum(n) FROM t)', 'top5')}")
def a17(spark, sf):
    s = table(spark, sf, "lineitem").where("l_linenumber <= 2").select("l_orderkey", "l_suppkey")
    rep = s.groupBy("l_orderkey").count().where("count > 2").agg(F.count("*").alias("repeated"))
    missing = table(spark, sf, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count("*").alias("missing"))
    n = s.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n")).limit(5).agg(F.sum("n").alias("t"))
    all_ = n.agg(F.count("*").alias("n_species"), F.sum("n").alias("a"))
    return rep.crossJoin(missing).crossJoin(all_).crossJoin(top).select("repeated", "missing", "n_species", (F.col("t") / F.col("a")).alias("top5"))


@query("a18_volume_changes", "WITH a AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT l_suppkey, coalesce(a.n, 0) - coalesce(b.n, 0) AS change FROM a FULL JOIN b USING (l_suppkey) ORDER BY change DESC, l_suppkey LIMIT 5")
def a18(spark, sf):
    c = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    t = table(spark, sf, "lineitem").where("l_returnflag in ('A', 'R')").groupBy("l_suppkey").agg(F.sum(c).alias("change"))
    return t.orderBy(F.desc("change"), "l_suppkey").limit(5)


@query("a20_missing_sample", f"WITH {LI} SELECT key FROM li WHERE key NOT IN (SELECT key FROM li WHERE l_partkey % 10 <> 0) ORDER BY md5('7:' || key), key LIMIT 20")
def a20(spark, sf):
    li = lines(spark, sf)
    there = li.where("l_partkey % 10 <> 0").select("key")
    return li.join(there, "key", "left_anti").orderBy(C.shuffle_key("key", 7), "key").limit(20).select("key")


@query("a21_label_audit", "SELECT count(*) FILTER (x < 0) AS negative, count(*) FILTER (x >= 90) AS outside, (SELECT count(*) FROM range(90) g(i) WHERE i NOT IN (SELECT l_suppkey - 5 FROM lineitem)) AS absent FROM (SELECT l_suppkey - 5 AS x FROM lineitem)")
def a21(spark, sf):
    t = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") - 5).alias("x")).agg(F.count("*").alias("n"))
    absent = spark.range(90).join(t, F.col("id") == F.col("x"), "left_anti").agg(F.count("*").alias("absent"))
    z = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return t.agg(z(F.col("x") < 0).alias("negative"), z(F.col("x") >= 90).alias("outside")).crossJoin(absent)


CAPPED = f"WITH {LI}, o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY md5('42:' || key), key) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM li)"


@query("w01_cap", f"{CAPPED} SELECT l_suppkey, key FROM o WHERE i <= 25")
def w01(spark, sf):
    return C.cap(lines(spark, sf), "l_suppkey", 25, "key").select("l_suppkey", "key")


@query("w02_global_cap", f"WITH {LI} SELECT key FROM li ORDER BY md5('42:' || key), key LIMIT 200")
def w02(spark, sf):
    return lines(spark, sf).orderBy(C.shuffle_key("key"), "key").limit(200).select("key")


@query("w03_stratified_split", f"{CAPPED} SELECT key, CASE WHEN i <= CASE WHEN n < 5 THEN 0 ELSE greatest(1, floor(n * 0.1)) END THEN 'val' ELSE 'train' END AS split FROM o")
def w03(spark, sf):
    return C.split_train(lines(spark, sf), "l_suppkey", 0.1, "key").select("key", "split")


@query("w04_plain_split", f"WITH {LI}, o AS (SELECT key, row_number() OVER (ORDER BY md5('42:' || key), key) AS i, count(*) OVER () AS n FROM li) SELECT key, CASE WHEN i <= greatest(1, round_even(n * 0.1, 0)) THEN 'val' ELSE 'train' END AS split FROM o")
def w04(spark, sf):
    return C.split_plain(lines(spark, sf), 0.1, "key").select("key", "split")


@query("w05_ratio_split", f"{CAPPED} SELECT l_suppkey, CASE WHEN i <= greatest(1, floor(n * 0.2)) THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM o GROUP BY 1, 2")
def w05(spark, sf):
    return C.split_train(lines(spark, sf), "l_suppkey", 0.2, "key", least=1).groupBy("l_suppkey", "split").agg(F.count("*").alias("n"))


@query("w06_support_by_priority", f"WITH {LI}, o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, key) AS i FROM li) SELECT l_suppkey, key FROM o WHERE i <= 4")
def w06(spark, sf):
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    w = Window.partitionBy("l_suppkey").orderBy(rank, "key")
    return lines(spark, sf).withColumn("i", F.row_number().over(w)).where("i <= 4").select("l_suppkey", "key")


@query("w07_support_query", f"WITH {LI}, o AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY key) AS i, count(*) OVER (PARTITION BY l_partkey) AS n FROM li) SELECT l_partkey, key, CASE WHEN i <= 5 THEN 'support' ELSE 'query' END AS part FROM o WHERE n >= 12 AND i <= 15")
def w07(spark, sf):
    return C.support_and_query(lines(spark, sf), "l_partkey", [F.col("key")], 5, 10, 12).select("l_partkey", "key", "part")


@query("w08_weighted_draws", f"WITH {LI}, w AS (SELECT key, CAST(l_quantity AS DOUBLE) AS w, sum(CAST(l_quantity AS DOUBLE)) OVER (ORDER BY md5('42:' || key), key ROWS UNBOUNDED PRECEDING) AS upto, sum(CAST(l_quantity AS DOUBLE)) OVER () AS total FROM li), d AS (SELECT i AS draw, (i + CAST('0x' || substr(md5('42:' || i), 1, 8) AS BIGINT) / 4294967296.0) / 500 * (SELECT max(total) FROM w) AS place FROM range(500) g(i)) SELECT draw, key FROM d JOIN w ON place >= upto - w AND place < upto")
def w08(spark, sf):
    return C.weighted_draws(lines(spark, sf), F.col("l_quantity"), 500, "key")


@query("w09_class_weights", f"SELECT l_suppkey, count(*) AS n, {r('1 / sqrt(count(*))', 'weight')} FROM lineitem GROUP BY 1")
def w09(spark, sf):
    return C.class_weights(table(spark, sf, "lineitem"), "l_suppkey", 0.5)


@query("w17_propagate", "WITH v AS (SELECT o_orderkey, o_custkey, l_suppkey, max(1 - l_discount) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3), many AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1), hi AS (SELECT DISTINCT o_custkey, l_suppkey FROM v WHERE p > 0.98) SELECT o_orderkey, hi.l_suppkey, round(CAST(0.96 AS DOUBLE), 6) AS p FROM orders JOIN hi USING (o_custkey) JOIN many USING (o_custkey) WHERE (o_orderkey, hi.l_suppkey) NOT IN (SELECT o_orderkey, l_suppkey FROM v)")
def w17(spark, sf):
    """Species that any visit of a plot is sure of are added to its other visits."""
    visits = table(spark, sf, "orders").select(F.col("o_orderkey").alias("visit"), F.col("o_custkey").alias("plot"))
    seen = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("visit"), F.col("l_suppkey").alias("species"), (1 - F.col("l_discount")).alias("p"))
    return C.propagated(visits, seen, 0.98).select(F.col("visit").alias("o_orderkey"), F.col("species").alias("l_suppkey"), F.lit(0.96).alias("p"))


@query("u01_union_align", "SELECT source, kind, count(*) AS n FROM (SELECT l_returnflag AS source, l_linestatus AS kind FROM lineitem UNION ALL SELECT o_orderstatus, NULL FROM orders) GROUP BY 1, 2")
def u01(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("kind"))
    return C.union_by_name(a, table(spark, sf, "orders").select(F.col("o_orderstatus").alias("source"))).groupBy("source", "kind").agg(F.count("*").alias("n"))


@query("u02_union_fill", "SELECT source, kind, count(*) AS n FROM (SELECT l_returnflag AS source, l_linestatus AS kind FROM lineitem UNION ALL SELECT o_orderstatus, '' FROM orders) GROUP BY 1, 2")
def u02(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("kind"))
    return C.union_by_name(a, table(spark, sf, "orders").select(F.col("o_orderstatus").alias("source")), "").groupBy("source", "kind").agg(F.count("*").alias("n"))


@query("u03_keep_first", f"WITH {LI}, o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY key) AS i FROM li) SELECT l_orderkey, l_linenumber, key FROM o WHERE i = 1")
def u03(spark, sf):
    return C.first_by(lines(spark, sf), ["l_orderkey", "l_linenumber"], F.asc("key")).select("l_orderkey", "l_linenumber", "key")


@query("u04_keep_last", f"WITH {LI}, o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY key DESC) AS i FROM li) SELECT l_orderkey, l_linenumber, key FROM o WHERE i = 1")
def u04(spark, sf):
    return C.first_by(lines(spark, sf), ["l_orderkey", "l_linenumber"], F.desc("key")).select("l_orderkey", "l_linenumber", "key")


@query("u05_only_new", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 40 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 8)")
def u05(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.where("l_quantity > 40").select("l_partkey").subtract(li.where("l_quantity < 8").select("l_partkey"))


@query("u07_verified_and_pseudo", "SELECT is_pseudo, count(*) AS n FROM (SELECT false AS is_pseudo FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT true FROM lineitem WHERE l_returnflag = 'N' AND 1 - l_discount >= 0.98) GROUP BY 1")
def u07(spark, sf):
    li = table(spark, sf, "lineitem")
    both = li.where("l_returnflag = 'A'").withColumn("is_pseudo", F.lit(False)).unionByName(li.where("l_returnflag = 'N' and 1 - l_discount >= 0.98").withColumn("is_pseudo", F.lit(True)))
    return both.groupBy("is_pseudo").agg(F.count("*").alias("n"))


@query("u08_byte_hash", "SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def u08(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
