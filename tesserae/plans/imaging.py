"""Queries of pixel measures, on pictures that Spark makes of the embeddings: 8 x 8 pixels, one for each number."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.lineage import scratch
from tesserae.operators import boxes as B
from tesserae.operators import image_hashes as H
from tesserae.operators import pixels as X
from tesserae.plans.registry import query, r
from tesserae.plans.views import table

SIDE = 8
#: A number's colours: green grows with it, red and blue are of its place.
PIXELS = """px AS (SELECT vec_id, i - 1 AS at, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(i * 5 % 97 AS INT) AS red, CAST(least(255, floor(abs(CAST(embedding[i] AS DOUBLE)) * 400)) AS INT) AS green,
 CAST(i * 11 % 89 AS INT) AS blue FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)), gray AS (SELECT *, 0.299 * red + 0.587 * green + 0.114 * blue AS g FROM px)"""


def pictures(spark, sf, numbers=None):
    """(image) structs like those of Spark's image reader, three channels with blue first; of other numbers, where given."""
    two = lambda c: F.lpad(F.hex(c.cast("bigint")), 2, "0")
    pixel = lambda v, i: F.concat(two((i + 1) * 11 % 89), two(F.least(F.lit(255), F.floor(F.abs(v.cast("double")) * 400))), two((i + 1) * 5 % 97))
    data = F.unhex(F.array_join(F.transform("embedding" if numbers is None else numbers, pixel), ""))
    side = F.lit(SIDE)
    return table(spark, sf, "embeddings").select("vec_id", F.struct(F.col("vec_id").cast("string").alias("origin"), side.alias("height"), side.alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), data.alias("data")).alias("image"))


@query("i05_vegetation", f"WITH {PIXELS}, s AS (SELECT *, red + green + blue AS t FROM px) SELECT CAST(vec_id AS VARCHAR) AS origin, {r('avg(CASE WHEN t > 0 AND (2.0 * green - red - blue) / t > 0.1 THEN 1.0 ELSE 0 END)', 'veg')}, {r('avg(CASE WHEN t > 0 AND (2.0 * green - red - blue) / t > 0.1 AND green > red AND green > blue THEN 1.0 ELSE 0 END)', 'veg_guarded')} FROM s GROUP BY 1")
def i05(spark, sf):
    return X.measure(pictures(spark, sf)).select("origin", "veg", "veg_guarded")


_FLAT = f"{PIXELS}, lap AS (SELECT c.vec_id, c.g, u.g + d.g + l.g + e.g - 4 * c.g AS lap FROM gray c JOIN gray u ON u.vec_id = c.vec_id AND u.x = c.x AND u.y = greatest(c.y - 1, 0) JOIN gray d ON d.vec_id = c.vec_id AND d.x = c.x AND d.y = least(c.y + 1, 7) JOIN gray l ON l.vec_id = c.vec_id AND l.y = c.y AND l.x = greatest(c.x - 1, 0) JOIN gray e ON e.vec_id = c.vec_id AND e.y = c.y AND e.x = least(c.x + 1, 7)), ms AS (SELECT vec_id, var_pop(g) AS variance, var_pop(lap) AS laplacian FROM lap GROUP BY 1)"


@query("i06_flatness", f"WITH {_FLAT} SELECT CAST(vec_id AS VARCHAR) AS origin, round(variance, 3) AS variance, round(laplacian, 3) AS laplacian FROM ms")
def i06(spark, sf):
    return X.measure(pictures(spark, sf)).select("origin", F.round("variance", 3).alias("variance"), F.round("laplacian", 3).alias("laplacian"))


@query("i06_skip_rate", f"WITH {_FLAT} SELECT count(*) AS images, {r('avg(CASE WHEN variance < 1000 OR laplacian < 15000 THEN 1.0 ELSE 0 END)', 'skipped')} FROM ms")
def i06_rate(spark, sf):
    return X.skip_rate(X.measure(pictures(spark, sf)), 1000.0, 15000.0)


@query("i07_broken_files", "SELECT 'img/' || vec_id AS path, CASE WHEN 1000 + vec_id % 50 <= 1024 THEN 'small' ELSE 'undecodable' END AS reason FROM embeddings WHERE 1000 + vec_id % 50 <= 1024 OR vec_id % 7 = 0")
def i07(spark, sf):
    """A listing of files with their sizes, and those that a decoder has read."""
    e = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("img/"), "vec_id").alias("path"))
    return X.broken(e.select("path", (1000 + F.col("vec_id") % 50).alias("length")), e.where("vec_id % 7 <> 0").select(F.col("path").alias("origin")))


@query("i08_noise_share", f"WITH {PIXELS} SELECT vec_id AS image_id, CAST(y // 4 * 2 + x // 4 AS INT) AS tile_id, {r('avg(CASE WHEN red + green + blue > 0 AND green > 60 THEN 1.0 ELSE 0 END)', 'noise_fraction')} FROM px GROUP BY 1, 2")
def i08(spark, sf):
    """Masks are the pixels with much green, the rest black; boxes are a grid of 2 x 2."""
    two = lambda c: F.lpad(F.hex(c.cast("bigint")), 2, "0")
    much = lambda v: F.least(F.lit(255), F.floor(F.abs(v.cast("double")) * 400))
    data = F.unhex(F.array_join(F.transform("embedding", lambda v: two(F.when(much(v) > 60, 255).otherwise(0))), ""))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), data.alias("data"))
    masks = e.select("image_id", F.struct("height", "width", F.lit(1).alias("nChannels"), "data").alias("image"))
    return X.noise_share(masks, B.grid(e.select("image_id", "width", "height"), 2))


#: Up to four pixels of each picture are taken anew: the picture after another download.
_AGAIN = "(i - 1 + 64 - vec_id * 7 % 64) % 64 % 13 = 0 AND (i - 1 + 64 - vec_id * 7 % 64) % 64 // 13 < vec_id % 5"
_BITS = "SELECT vec_id, CAST(string_agg(CASE WHEN g > m THEN '1' ELSE '0' END, '' ORDER BY i) AS BIT) AS h FROM (SELECT vec_id, i, g, avg(g) OVER (PARTITION BY vec_id) AS m FROM {0}) GROUP BY 1"
_GRAY = "SELECT vec_id, i, 0.299 * (i * 5 % 97) + 0.587 * least(255, floor(abs(v) * 400)) + 0.114 * (i * 11 % 89) AS g FROM {0}"


def _again():
    """The numbers of a picture with some of them taken anew."""
    at = lambda i: (i + 64 - F.col("vec_id") * 7 % 64) % 64
    return F.transform("embedding", lambda x, i: F.when((at(i) % 13 == 0) & (F.floor(at(i) / 13) < F.col("vec_id") % 5), 0.6 - F.abs(x.cast("double"))).otherwise(x.cast("double")))


@query("u08_near_images", f"""WITH n AS (SELECT vec_id, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
a AS (SELECT vec_id, i, CASE WHEN {_AGAIN} THEN 0.6 - abs(x) ELSE x END AS v FROM n), b AS (SELECT vec_id, i, x AS v FROM n),
ga AS ({_GRAY.format('a')}), gb AS ({_GRAY.format('b')}), ha AS ({_BITS.format('ga')}), hb AS ({_BITS.format('gb')}),
near AS (SELECT ha.vec_id, CAST(hb.vec_id AS VARCHAR) AS old, CAST(4 * bit_count(xor(ha.h, hb.h)) AS INT) AS d FROM ha, hb WHERE 4 * bit_count(xor(ha.h, hb.h)) <= 24),
best AS (SELECT vec_id, count(*) AS n, min(d) AS d FROM near GROUP BY 1)
SELECT CAST(ha.vec_id AS VARCHAR) AS path, coalesce(n, 0) AS n_near, best.d AS distance, (SELECT min(old) FROM near WHERE near.vec_id = ha.vec_id AND near.d = best.d) AS nearest FROM ha LEFT JOIN best USING (vec_id)""")
def u08_near(spark, sf):
    """Pictures of a second download, with pixels changed, against those of the first."""
    hashes = lambda p: X.measure(p).select(F.col("origin").alias("path"), "ahash")
    return H.near_images(hashes(pictures(spark, sf, _again())), hashes(pictures(spark, sf)), 24).drop("ahash")


@query("u08_hash_snapshot", "SELECT CAST(vec_id AS VARCHAR) AS path, CAST(192 + CASE WHEN label = 0 THEN 1 ELSE 0 END AS BIGINT) AS length, true AS ok, CAST(CASE WHEN label BETWEEN 1 AND 4 THEN 1 ELSE 2 END AS BIGINT) AS batch, length(embedding) = 64 AS hashed FROM embeddings")
def u08_snapshot(spark, sf):
    """A first crawl has the labels below 5; the second has all, and those of label 0 with another length. Only what is new is hashed."""
    out = scratch(spark, "hashes")
    crawl = pictures(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    crawl = crawl.select("image", "label", F.col("image.origin").alias("path"), F.octet_length("image.data").cast("bigint").alias("length"))

    def hashed(new):
        seen = X.measure(new).select(F.col("origin").alias("path"), "ahash")
        exact = new.select("path", "length", F.sha2("image.data", 256).alias("sha256"))
        return exact.join(seen, "path").select("path", "length", "sha256", "ahash", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))

    H.hash_new(crawl.where("label < 5"), out, 1, hashed)
    H.hash_new(crawl.withColumn("length", F.col("length") + (F.col("label") == 0).cast("int")), out, 2, hashed)
    return H.snapshot(spark, out).select("path", "length", "ok", "batch", (F.length("ahash") == 64).alias("hashed"))
