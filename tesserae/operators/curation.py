"""Manifest curation: clean, align, union, remove repeats, cap, split, weigh, audit.

A manifest has one row for each image. Orders that decide which rows stay are by md5 of a
seed and a key, so that they are the same on every cluster and in SQL.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions.lineage import cut
from tesserae.functions.ordinals import numbered
from tesserae.functions.orders import TASK_ROWS, hashed, places, shuffle_key

#: Parts of the largest weight in a line of draws; ten thousand million rows of that weight keep sums in 64 bits.
LINE_PARTS = 1 << 29


def align(df: DataFrame, columns: list[str], kind: str = "string") -> DataFrame:
    """Exactly these columns in order; missing ones are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c in columns])


def resolve(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Renames the first column found, in any case, of each canonical name's aliases."""
    have = {c.lower(): c for c in df.columns}
    found = {name: next((have[a.lower()] for a in [name, *names] if a.lower() in have), None) for name, names in aliases.items()}
    renamed = {source: name for name, source in found.items() if source}
    return df.select(*[F.col(c).alias(renamed.get(c, c)) for c in df.columns])


def image_path(path: Column, root: str, species: Column, name: Column) -> Column:
    """The path if there is one, else root/species/name."""
    return F.coalesce(F.nullif(F.trim(path), F.lit("")), F.concat_ws("/", F.lit(root), species, name))


def relative_path(path: Column, from_root: str, to_root: str) -> Column:
    """A path below from_root, as seen from to_root."""
    a, b = ([p for p in r.split("/") if p] for r in (from_root, to_root))
    shared = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    prefix = "".join(["../"] * (len(b) - shared) + [f"{p}/" for p in a[shared:]])
    return F.concat(F.lit(prefix), path)


def padded_dir(species: Column, width: int = 4) -> Column:
    return F.lpad(species.cast("string"), width, "0")


def clean_space(c: Column) -> Column:
    """Runs of white space and no-break spaces as one space; blank is null."""
    return F.nullif(F.trim(F.regexp_replace(c, "[\\s ]+", " ")), F.lit(""))


def clean_name(canonical: Column, raw: Column) -> Column:
    """The canonical name if there is one, else the raw name without its author, else raw."""
    stripped = F.regexp_extract(raw, r"^([A-Z][a-z-]+(?: [a-z-]+)+)", 1)
    return F.coalesce(clean_space(canonical), F.nullif(stripped, F.lit("")), raw)


def binomial(name: Column) -> Column:
    """The first two words."""
    return F.array_join(F.slice(F.split(F.trim(name), r"\s+"), 1, 2), " ")


def clean_list(c: Column, sep: str = "\\|", sentence: bool = False) -> Column:
    """Items of a separated list, trimmed and without blanks; repeats in any case keep the first."""
    items = F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")
    if sentence:
        items = F.transform(items, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1_000_000))))
    start = F.array().cast("array<string>")
    return F.aggregate(items, start, lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.concat(a, F.array(x))))


def prompts(df: DataFrame, templates: list[str], names: Column, most: int) -> DataFrame:
    """Adds prompts: every template with every name, {} standing for it; repeats in any case go."""
    made = F.flatten(F.transform(F.slice(names, 1, most), lambda n: F.array(*[F.concat(F.lit(t.split("{}")[0]), n, F.lit(t.split("{}")[1])) for t in templates])))
    return df.withColumn("prompts", clean_list(F.array_join(made, "|")))


def medium_url(url: Column) -> Column:
    return F.regexp_replace(url, r"/(original|large)\.", "/medium.")


def repair_number(c: Column) -> Column:
    """The number in texts such as tensor(0.12); 0 where there is none."""
    return F.coalesce(F.regexp_extract(c, r"-?\d+(?:\.\d+)?(?:[eE]-?\d+)?", 0).try_cast("double"), F.lit(0.0))


def ids_in(c: Column) -> Column:
    """All whole numbers in a text, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(-?\d+)"), 1), lambda x: x.cast("bigint"))


def listed(ids: Column) -> Column:
    """The written form of an id list: [1, 2]."""
    return F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ", "), F.lit("]"))


def only_digits(items: Column) -> Column:
    return F.filter(items, lambda x: x.rlike(r"^-?\d+$"))


def plot_of(quadrat: Column) -> Column:
    return F.regexp_replace(quadrat, r"-[^-]*$", "")


def date_of(quadrat: Column) -> Column:
    """The date in the last eight characters, or null."""
    return F.try_to_timestamp(F.right(quadrat, F.lit(8)), F.lit("yyyyMMdd")).cast("date")


def day_of_year(c: Column) -> Column:
    """The day of the first run of eight digits that is a date of 1900 to 2100; day 366 counts as 365."""
    runs = F.transform(F.regexp_extract_all(c, F.lit(r"(?<!\d)(\d{8})(?!\d)"), 1), lambda x: F.try_to_timestamp(x, F.lit("yyyyMMdd")).cast("date"))
    good = F.filter(runs, lambda d: d.isNotNull() & F.year(d).between(1900, 2100))
    return F.when(F.size(good) > 0, F.least(F.dayofyear(good[0]), F.lit(365)))


def local_path(c: Column) -> Column:
    """Backslashes as slashes, and drive letters as mounts."""
    slashed = F.translate(c, "\\", "/")
    drive = F.lower(F.regexp_extract(slashed, r"^([A-Za-z]):/", 1))
    return F.when(drive != "", F.concat(F.lit("/mnt/"), drive, F.regexp_replace(slashed, r"^[A-Za-z]:", ""))).otherwise(slashed)


def fill_taxonomy(df: DataFrame, tax: DataFrame, key: str, columns: list[str], least: Column | None = None) -> DataFrame:
    """df with missing columns from a lookup; its own values are preferred, and rows stay as many.

    The lookup keeps one row for each key, the smallest by `least` or else by its columns.
    """
    order = least if least is not None else F.struct(*columns)
    one = tax.groupBy(key).agg(*[F.min_by(F.struct(*columns), order).alias("__t")])
    own = [F.coalesce(F.col(c), F.col(f"__t.{c}")).alias(c) if c in df.columns else F.col(f"__t.{c}").alias(c) for c in columns]
    return df.join(one, key, "left").select(*[F.col(c) for c in df.columns if c not in columns], *own)


def union_by_name(a: DataFrame, b: DataFrame, fill: str | None = None) -> DataFrame:
    """All columns of both; missing ones are null, or fill."""
    out = a.unionByName(b, allowMissingColumns=True)
    return out.na.fill(fill) if fill is not None else out


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, first by the order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def cap(df: DataFrame, group: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """At most n rows of each group, in a reproducible random order."""
    w = Window.partitionBy(group).orderBy(shuffle_key(key, seed), key)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def split_train(df: DataFrame, group: str, share: float, key: str, seed: int = 42, least: int = 5) -> DataFrame:
    """Adds split: of groups with `least` rows or more, max(1, int(n * share)) go to val."""
    n = F.col("__of")
    val = F.when(n < least, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n * share)))
    return places(df, [group], key, seed).withColumn("split", F.when(F.col("__at") <= val, "val").otherwise("train")).drop("__at", "__of")


def split_plain(df: DataFrame, share: float, key: str, seed: int = 42) -> DataFrame:
    """Adds split: the max(1, round(share * n)) rows of the smallest hashes are val, all others train."""
    val = F.greatest(F.lit(1), F.bround(F.col("__of") * share).cast("long"))
    return places(df, [], key, seed).withColumn("split", F.when(F.col("__at") <= val, "val").otherwise("train")).drop("__at", "__of")


def support_and_query(df: DataFrame, group: str, order: list[Column], k: int, most_query: int, least: int) -> DataFrame:
    """Adds part: the first k rows of groups with `least` or more are support, the next are query, up to most_query."""
    enough = df.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select("__g")
    first = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    # A group's first rows alone are kept, so Spark drops the others before they meet.
    t = df.join(enough, F.col(group).eqNullSafe(F.col("__g")), "left_semi").withColumn("__r", first).where(F.col("__r") <= k + most_query)
    part = F.when(F.col("__r") <= k, "support").when(F.col("__r") <= k + most_query, "query")
    return t.withColumn("part", part).drop("__r")


def propagated(visits: DataFrame, seen: DataFrame, least: float) -> DataFrame:
    """(visit, species): what any visit of a plot has above `least`, for the plot's other visits; plots of one visit get none.

    A visit is sure of a species if one of its rows is, so no maximum is taken, and what the visits have already is left out
    as it stands. The pairs are counted before they are made, and dealt to as many tasks as their number asks for.
    visits: (visit, plot); seen: (visit, species, p).
    """
    many = visits.groupBy("plot").agg(F.count("*").alias("n")).where("n > 1")
    held = visits.hint("merge")
    sure = seen.where(F.col("p") > least).select("visit", "species").join(held, "visit").select("plot", "species").distinct()
    sure = cut(sure.join(many, "plot"))
    rows = seen.count() + (sure.agg(F.sum("n")).first()[0] or 0)
    tasks = max(visits.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    # The pairs follow the deal of the other side; dealt by themselves, Spark would deal them once more behind the join.
    had = seen.select("visit", "species").repartition(tasks, "visit", "species").hint("merge")
    return held.join(sure.drop("n"), "plot").select("visit", "species").join(had, ["visit", "species"], "left_anti")


def class_weights(df: DataFrame, group: str, power: float) -> DataFrame:
    """(group, n, weight): weight n to the power -power."""
    return df.groupBy(group).agg(F.count("*").alias("n")).withColumn("weight", F.pow(F.col("n"), F.lit(-power)))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, share, n_distinct) of each column, in one pass."""
    full = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    one = df.agg(F.count("*").alias("n"), *[F.count(full(c)).alias(f"f_{c}") for c in columns], *[F.count_distinct(full(c)).alias(f"d_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"f_{c}").alias("filled"), (F.col(f"f_{c}") / F.col("n")).alias("share"), F.col(f"d_{c}").alias("n_distinct")) for c in columns])
    return one.select(F.inline(rows))


def count_stats(counts: DataFrame, bins: list[int]) -> DataFrame:
    """(bin, n_groups): how many groups have up to each number of rows; -1 stands for more."""
    b = F.lit(-1)
    for x in sorted(bins, reverse=True):
        b = F.when(F.col("n") <= x, F.lit(x)).otherwise(b)
    return counts.groupBy(b.alias("bin")).agg(F.count("*").alias("n_groups"))


def encode(df: DataFrame, column: str) -> DataFrame:
    """(value, code): sorted distinct values, without nulls and blanks, numbered from zero.

    Only distinct values are put in one order, by ranges over tasks.
    """
    values = df.select(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")).alias("value")).where("value is not null").distinct()
    return numbered(values, "value", out="code").withColumn("code", F.col("code").cast("int"))


def apply_code(df: DataFrame, codes: DataFrame, column: str, out: str) -> DataFrame:
    """df with the code of column, -1 where there is none."""
    c = codes.select(F.col("value").alias("__v"), F.col("code").alias(out))
    key = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
    return df.withColumn("__k", key).join(c, F.col("__k") == F.col("__v"), "left").drop("__k", "__v").fillna(-1, [out])


def mode_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, of equals the smallest; -1 where all are null."""
    c = df.groupBy(*keys, value).agg(F.count(value).alias("n"))
    return c.groupBy(*keys).agg(F.coalesce(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct("n", -F.col(value)))), F.lit(-1)).alias(value))


def weighted_draws(df: DataFrame, weight: Column, n: int, key: str, seed: int = 42) -> DataFrame:
    """(draw, key): n draws with replacement by weight; invalid and negative weights count as zero.

    Rows lie side by side on a line in a reproducible random order, each as long as its
    weight; draw i falls at a reproducible place in the i-th of n equal parts of it. Lengths are whole numbers, parts of the largest
    weight (a positive weight has one at least), so sums are exact and the line is the same however rows are dealt; sums by hash
    prefix come first, so that it is laid out by many tasks.
    """
    w = F.when(weight.isNull() | F.isnan(weight) | (weight < 0), 0.0).otherwise(weight).cast("double")
    t = df.select(F.col(key).alias("key"), w.alias("w"), shuffle_key(key, seed).alias("h"))
    rows, most = t.agg(F.count("*"), F.max("w")).first()
    if not most:
        return t.limit(0).select(F.lit(0).cast("bigint").alias("draw"), "key")
    length = F.when(F.col("w") > 0, F.greatest(F.lit(1), F.round(F.col("w") / F.lit(most) * LINE_PARTS))).otherwise(0).cast("bigint")
    digits = next((d for d in range(1, 5) if rows <= 50_000 * 16**d), 5)
    t = t.select("key", "h", length.alias("w"), F.substring("h", 1, digits).alias("b")).where("w > 0")
    per = t.groupBy("b").agg(F.sum("w").alias("s"))
    high = F.substring("b", 1, digits - digits // 2)  # two levels of prefixes, so that no window sees all of them
    top = {r["c"]: r["s"] for r in per.groupBy(high.alias("c")).agg(F.sum("s").alias("s")).collect()}
    total, starts = 0, {}
    for c in sorted(top):
        starts[c], total = total, total + top[c]
    first_of = F.element_at(F.from_json(F.lit(json.dumps(starts)), "map<string,bigint>"), F.col("c"))
    before = per.withColumn("c", high).withColumn("start", F.sum("s").over(Window.partitionBy("c").orderBy("b")) - F.col("s") + first_of).select("b", "start")
    line = t.join(before, "b").withColumn("upto", F.sum("w").over(Window.partitionBy("b").orderBy("h", "key")) + F.col("start")).withColumn("from", F.col("upto") - F.col("w"))
    first, last = F.floor(F.col("from") / F.lit(float(total)) * n), F.floor(F.col("upto") / F.lit(float(total)) * n)
    hit = line.select("key", "from", "upto", F.explode(F.sequence(first, F.least(last, F.lit(n - 1)))).alias("draw"))
    place = (F.col("draw") + hashed(F.lit(str(seed)), F.col("draw").cast("string")) / float(1 << 32)) / n * float(total)
    return hit.where((place >= F.col("from")) & (place < F.col("upto"))).select("draw", "key")
