"""Quality rules with DataFrame functions alone: fixed limits, then cross-document line frequency.

Lines are normalised (lower case, single spaces, trimmed) and hashed. A line that more
than max_host_documents distinct documents of a host have is boilerplate there; a
document with more than max_removed of its words in such lines is depleted. Copies
say nothing about boilerplate, so documents count as distinct if their sets of lines
differ, by a digest of all their line hashes: a notice below different articles counts
once for each article, however many lines these share, while a thousand copies of one
article count once for each of its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut

#: White space that parts words, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]+"
#: A line is boilerplate in a host if more distinct documents than this have it.
MAX_HOST_DOCUMENTS = 50
#: A document is depleted if more than this share of its words stands in such lines.
MAX_REMOVED = 0.6
#: Lines above the limit that are few enough to send to every task.
BROADCAST_LINES = 20_000


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each row of docs: its counts, its lines' hashes and their words."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{host_col}`").cast("string")).alias("host"), text.alias("text"))
    d = d.select("*", _words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("w")
    places = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2))
    d = d.select(
        "row", "id", "host",
        n.cast("bigint").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        # Windows in the order of their hashes: equal ones stand side by side.
        F.sort_array(F.transform(places, lambda i: F.struct(window(i).alias("h"), i.alias("i")))).alias("k"),
        F.transform("lines", lambda x: F.xxhash64(_normal(x))).alias("hs"),
        F.transform("lines", lambda x: F.size(_words(x))).alias("ns"),
    )
    twice = F.filter("k", lambda x, j: (x["h"] == F.get("k", j - 1)["h"]) | (x["h"] == F.get("k", j + 1)["h"]))
    d = d.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("at"), F.xxhash64(F.sort_array(F.array_distinct("hs"))).alias("digest")).drop("k")
    # Each repeated window adds up to three words, less what the one before has covered.
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("at", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).cast("bigint").alias("n"), p.alias("last")), lambda a: a["n"])
    d = d.select("*", covered.alias("n_repeat_words")).drop("at")
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _lines(base: DataFrame) -> DataFrame:
    """(row, host, h, n, digest) for each line with a word; digest stands for the whole document."""
    return base.select("row", "host", "digest", F.inline(F.arrays_zip("hs", "ns"))).select("row", "host", F.col("hs").alias("h"), F.col("ns").alias("n"), "digest")


def _small(df: DataFrame) -> DataFrame:
    """df, computed once, and sent to every task if it has few rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_LINES else df


def boilerplate(lines: DataFrame, max_host_documents: int) -> tuple[DataFrame, DataFrame]:
    """The lines that may be above the limit, and (host, h) of those that are."""
    often = _small(lines.groupBy("host", "h").agg(F.count("*").alias("c")).where(F.col("c") > max_host_documents).select("host", "h"))
    near = lines.join(often, ["host", "h"])
    own = near.groupBy("host", "h", "digest").agg(F.count("*").alias("c"))
    return near, _small(own.groupBy("host", "h").agg(F.count("*").alias("c")).where(F.col("c") > max_host_documents).select("host", "h"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_documents: int = MAX_HOST_DOCUMENTS, max_removed: float = MAX_REMOVED) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed, kept, removed).

    n_removed: words in lines above the host's limit; removed: these lines' hashes, for
    stripped(). kept is false if base_failed or if those words are more than max_removed
    of all. Null texts have no words and fail; rows without a host share one; repeated
    rows each get a row; an empty table gives an empty result; other columns of docs are
    ignored.
    """
    base = cut(base_rules(docs, id_col, text_col, host_col))
    near, over = boilerplate(_lines(base), max_host_documents)
    found = near.join(over, ["host", "h"], "left_semi").groupBy("row").agg(F.sum("n").alias("n_removed"), F.collect_set("h").alias("removed"))
    out = base.drop("host", "hs", "ns", "digest").join(found, "row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))
    out = out.withColumn("removed", F.coalesce("removed", F.array().cast("array<bigint>")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_removed") <= max_removed * F.col("n_words")))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed", "kept", "removed")


def stripped(text: Column, removed: Column) -> Column:
    """The text without the lines whose hashes are among removed; a null text stays null."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(removed, F.xxhash64(_normal(x)))), "\n")
