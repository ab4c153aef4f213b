"""Near copies by Jaccard similarity of word shingles: SimHash and MinHash bands find candidates, sets decide.

A text is the set of its five-word shingles, as 64-bit hashes. Rows with the same set are
one node. Nodes whose SimHash fingerprints are linked by the generalised pigeonhole of simhash.py are
candidates. Many similar sets have fingerprints further apart, so bands find the others: nodes that agree in all ROWS least values of one of BANDS bands are candidates:
two sets of similarity s are missed with a chance of (1 - s^ROWS)^BANDS, 5e-8 at 0.8 and less
above. A pair is a link if the exact similarity of its sets is LEAST or more.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import simhash
from tesserae.llm.common import cut, map_texts
from tesserae.llm.components import components

BANDS, ROWS = 32, 4
#: The least similarity of a link, as a fraction of whole numbers.
LEAST = (4, 5)
#: Rows, and hashes of sets, that are few enough to send to every task.
BROADCAST_ROWS, BROADCAST_HASHES = 100_000, 2 << 20
#: Shingles that so many open nodes or fewer have lead to the pairs that share them.
RARE = 8
#: Differing bits at which fingerprints are linked, and parts of a set whose shingles are counted for a bound.
DISTANCE, PARTS = 4, 64
_DRAWN = np.random.default_rng(20).integers(0, 1 << 32, (2, 1, BANDS * ROWS), dtype=np.uint32)
_TIMES, _PLUS = _DRAWN[0] | np.uint32(1), _DRAWN[1]


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    pairs = zip((ends - sizes)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[i:j], 42) for i, j in pairs), np.uint64, len(words) - size + 1))


def node(found: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes(), 7)], np.uint64).view(np.int64)[0])


def bands(found: np.ndarray) -> list[int]:
    """One hash for each band; none for an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 2048):
        least = np.minimum(least, (short[k : k + 2048, None] * _TIMES + _PLUS).min(0))
    raw, width = least.tobytes(), 4 * ROWS
    out = [xxhash.xxh64_intdigest(raw[b * width : (b + 1) * width], b) for b in range(BANDS)]
    return np.array(out, np.uint64).view(np.int64).tolist()


def _signed_texts():
    def apply(texts):
        out = []
        for t in texts:
            found = shingles(t)
            out.append((node(found), len(found), bands(found), simhash._signed(simhash.signature(found)) if len(found) else 0))
        return out

    return apply


def _set_texts():
    def apply(texts):
        found = [shingles(t) for t in texts]
        return [(node(x), x.view(np.int64).tolist()) for x in found]

    return apply


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _alike(pairs: DataFrame, sets: DataFrame, few: bool) -> DataFrame:
    """The (a, b) of pairs whose sets have LEAST of all their shingles in common."""
    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(F.broadcast(one) if few else one, "a").join(F.broadcast(two) if few else two, "b")
    both = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("c"))
    return both.where(LEAST[1] * F.col("c") >= LEAST[0] * (F.col("n") - F.col("c"))).select("a", "b")


def _pairs(found: DataFrame) -> DataFrame:
    """Distinct (a, b) of (p, np, q, nq), without pairs whose sizes are too far apart."""
    near = LEAST[1] * F.least("np", "nq") >= LEAST[0] * F.greatest("np", "nq")
    return found.where((F.col("p") != F.col("q")) & near).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def _close(nodes: DataFrame) -> DataFrame:
    """(p, q), structs of node, n and key, that connect the nodes whose fingerprints are linked."""
    nodes = nodes.where("n > 0").select("fp", F.struct("node", "n", "key").alias("p"))
    heads = cut(nodes.groupBy("fp").agg(F.min("p").alias("q")))
    found = simhash.links(heads.select("fp"), DISTANCE)
    apart = found.join(heads.select(F.col("fp").alias("a"), F.col("q").alias("p")), "a").join(heads.select(F.col("fp").alias("b"), "q"), "b")
    return cut(nodes.join(heads, "fp").select("p", "q").unionByName(apart.select("p", "q")).where("p.node <> q.node"))


def _counted(sets: DataFrame, lone: DataFrame, members: DataFrame) -> DataFrame:
    """(node, parts): of members' nodes, how many shingles that are not in lone stand in each of PARTS parts by hash."""
    part = F.pmod("h", F.lit(PARTS)).alias("part")
    of = _sent(cut(members.select("node").distinct()))
    rows = sets.join(of, "node", "left_semi").select("node", F.explode("hashes").alias("h")).select("node", part, F.lit(1).alias("c"))
    rows = rows.unionByName(lone.join(of, "node", "left_semi").select("node", part, F.lit(-1).alias("c")))
    counts = rows.groupBy("node", "part").agg(F.sum("c").alias("c")).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("part", "c"))).alias("m"))
    return counts.select("node", F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint")), lambda k: F.coalesce(F.col("m")[k], F.lit(0)).cast("int")).alias("parts"))


def links(base: DataFrame, docs: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """Nodes' components (node, root) over links; base has node, n, bands and key for each row.

    Nodes linked by fingerprints are held against each other. In every bucket all members are held against one of them, drawn anew in each bucket, so
    that large groups of near copies are joined in rows in proportion to their members. Where
    a bucket still has several components, shingles that no other open node has tell how much
    two nodes can share at most: nodes that can be alike to none are left out, the others are held
    against the one with the least share of such shingles. At last nodes of different
    components meet each other where they share a shingle that RARE nodes or fewer have, or
    where they can be alike by their other shingles alone: by the lesser counts in each part of these, which
    add up to what two sets can share at most.
    """
    nodes = cut(base.groupBy("node").agg(F.first("n").alias("n"), F.min("key").alias("key"), F.first("bands").alias("bands"), F.first("fp").alias("fp")))
    close = _close(nodes)
    members = nodes.select("node", "n", "key", F.explode("bands").alias("bucket"))
    draw = F.xxhash64("bucket", "node")
    drawn = members.groupBy("bucket").agg(F.count("*").alias("c"), F.min_by(F.struct("node", "n"), draw).alias("head")).where("c > 1")
    shared = cut(members.join(drawn.drop("c"), "bucket").select("bucket", "node", "n", "key", F.col("head.node").alias("q"), F.col("head.n").alias("nq")))
    first = shared.select(F.col("node").alias("p"), F.col("n").alias("np"), "q", "nq")
    first = cut(_pairs(first.unionByName(close.select(F.col("p.node").alias("p"), F.col("p.n").alias("np"), F.col("q.node").alias("q"), F.col("q.n").alias("nq")))))
    wanted = cut(shared.select("node", "n", "key").union(close.select(F.inline(F.array("p", "q")))).distinct())
    few = (wanted.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_HASHES
    texts = docs.join(_sent(wanted.select(F.col("key").alias(key_col)).distinct()), key_col, "left_semi")
    sets = cut(map_texts(texts, _set_texts, "node bigint, hashes array<bigint>", key_col, text_col).dropDuplicates(["node"]).drop(key_col))
    roots = components(_alike(first, sets, few))
    open_ = cut(_mixed(shared.select("bucket", "node", "n"), roots))
    if not open_.count():
        return roots
    each = cut(_sets_of(sets, open_).select("node", F.explode("hashes").alias("h")))
    rare = cut(each.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") <= RARE))
    lone = cut(each.join(_sent(rare), "h"))
    known = cut(lone.groupBy("node").agg(F.count_if(F.col("c") == 1).alias("alone"), F.count("*").alias("few")))
    able = open_.join(_sent(known), "node", "left").withColumn("e", F.col("n") - F.coalesce("alone", F.lit(0))).withColumn("er", F.col("n") - F.coalesce("few", F.lit(0)))
    able = cut(able.where(LEAST[1] * F.col("e") >= LEAST[0] * F.col("n")).select("bucket", "node", "n", "root", "e", "er"))
    middle = F.min_by(F.struct(*[F.col(c).alias(f"{c}q") for c in ("node", "n", "root", "e")]), F.struct(-F.col("e") / F.col("n"), F.xxhash64("bucket", "node")))
    heads = able.groupBy("bucket").agg(middle.alias("head")).select("bucket", "head.*")
    second = able.join(heads, "bucket").where("root <> rootq").where(_can_be_alike("n", "nq", "e", "eq")).select(F.col("node").alias("p"), F.col("n").alias("np"), F.col("nodeq").alias("q"), "nq")
    second = cut(_pairs(second).join(first, ["a", "b"], "left_anti"))
    roots = _joined(roots, cut(_alike(second, sets, few)))
    left = cut(_mixed(able.drop("root"), roots))
    side = lambda t, by, x, own="e": t.select(by, *[F.col(c).alias(f"{c}{x}") for c in ("node", "n", "root", "er", own)])
    common = left.where(LEAST[1] * F.col("er") >= LEAST[0] * F.col("n"))
    common = cut(common.join(_sent(cut(_counted(sets, lone, common))), "node"))
    tokens = lone.where("c > 1").select("node", "h").join(_sent(cut(left.drop("bucket").distinct())), "node")
    shares = F.aggregate(F.zip_with("partsp", "partsq", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    in_common = side(common, "bucket", "p", "parts").join(side(common, "bucket", "q", "parts"), "bucket").where("nodep < nodeq and rootp <> rootq").where(_can_be_alike("np", "nq", "erp", "erq")).where(sum(LEAST) * shares >= LEAST[0] * (F.col("np") + F.col("nq")))
    in_rare = side(tokens, "h", "p").join(side(tokens, "h", "q"), "h").where("nodep < nodeq and rootp <> rootq").where(_can_be_alike("np", "nq", "ep", "eq"))
    both = in_common.select("nodep", "np", "nodeq", "nq").unionByName(in_rare.select("nodep", "np", "nodeq", "nq"))
    rest = _pairs(both.select(F.col("nodep").alias("p"), "np", F.col("nodeq").alias("q"), "nq"))
    return _joined(roots, cut(_alike(cut(rest.join(first.union(second), ["a", "b"], "left_anti")), sets, few)))


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """roots (node, root) with more links: the links met so far are in the roots already."""
    return components(roots.union(more)) if more.count() else roots


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members of the buckets that hold several components, with their roots."""
    of = members.join(_sent(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = of.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("bucket")
    return of.join(several, "bucket", "left_semi")


def _sets_of(sets: DataFrame, members: DataFrame) -> DataFrame:
    return sets.join(_sent(cut(members.select("node").distinct())), "node", "left_semi")


def _can_be_alike(n: str, m: str, e: str, f: str) -> Column:
    """Whether sets of n and m shingles, of which e and f stand in other sets, can have LEAST in common."""
    a, b = LEAST
    return (a + b) * F.least(e, f) >= a * (F.col(n) + F.col(m))


def near_copies(docs: DataFrame, key_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id, component_id) for every row of docs.

    key_col is never null and the same only for equal rows. component_id is the smallest id
    reachable over links. Null and wordless texts are alike; repeated rows each get a row; an
    empty table gives an empty result; other columns of docs are ignored.
    """
    base = cut(map_texts(docs, _signed_texts, "node bigint, n int, bands array<bigint>, fp bigint", id_col, text_col, {"key": key_col}))
    firsts = cut(base.groupBy("node").agg(F.min(id_col).alias("first")))
    roots = links(base, docs, key_col, text_col)
    whole = cut(firsts.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    least = whole.groupBy("root").agg(F.min("first").alias("component_id"))
    of = cut(whole.join(least, "root").select("node", "component_id"))
    return base.join(of, "node").select(F.col("key").alias(key_col), F.col(id_col), "component_id")
