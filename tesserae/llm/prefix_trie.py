"""Trie of conversations' prefixes by union-find over the LCP edges of sorted neighbours.

Conversations are sequences of turn hashes; alike ones are contracted to one row. Rows are
sorted over tasks by ranges; the edge between neighbours is as deep as their common prefix.
Inside a partition edges are taken in descending depth: each merge of components creates a
branching node, and what a component holds at that moment is the path down from it. Nodes
that reach over a partition's boundaries stay open; each partition contracts them to sums, and
sums with the same prefix hash are merged. All counts of a node are sums over the rows below
it, so they need no second walk through the tree.

Sequences are held in sections of SECTION turns, so that no row grows with a conversation.
A section's rows are sorted under their prefix hash; leaves and savings of later
sections are added to the rows that lead to them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.common import cut, partitions, reachable

#: Turns in a row, turns of the first conversation of a hundred that the others may open with, ids in one piece of text.
SECTION, OPENING, IDS = 128, 5, 4096
_KEY = ["k", "pa", "pb"]


def _spread(df: DataFrame, *order) -> DataFrame:
    """df dealt and sorted by ranges, with its partition's number `part`, kept in the shared folder."""
    df = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return cut(df.withColumn("part", F.spark_partition_id()))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, at, x, y, n) of (conv, turn, x, y, n): at is a turn's place in its conversation, from 1.

    Places are sums of counts by partition and a rank inside it, so a conversation with most of the turns is
    numbered by many tasks.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("x").asc(), F.col("y").asc()]
    dealt = _spread(turns, F.col("conv").asc(), *order)
    per = dealt.groupBy("conv", "part").agg(F.count("*").alias("c"))
    before = per.withColumn("before", F.sum("c").over(Window.partitionBy("conv").orderBy("part")) - F.col("c")).drop("c")
    rank = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order))
    return dealt.withColumn("at", rank).join(before, ["conv", "part"]).select("conv", (F.col("at") + F.col("before")).alias("at"), "x", "y", "n")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, d, a, b, n) of rebuilt conversations, and all their ids (conv); a and b hash the turn and its depth d."""
    own = cut(numbered_turns(turns))
    ids = own.select("conv").distinct().withColumn("base", F.col("conv") - F.col("conv") % 100).withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % (OPENING + 1)).cast("int"))
    heads = own.where(F.col("at") <= OPENING).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("at", "x", "y", "n"))).alias("head"))
    ids = cut(ids.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(dict(heads.dtypes)["head"])), 1, F.col("h"))))
    opened = ids.select("conv", F.explode("head").alias("t")).select("conv", F.col("t.at").cast("bigint").alias("d"), "t.x", "t.y", "t.n")
    short = ids.select("conv", (F.col("h") - F.size("head")).alias("short")).where("short > 0")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (OPENING + 1)
    rest = own.where(F.col("at") > h).join(short, "conv", "left").select("conv", (F.col("at") - F.coalesce("short", F.lit(0))).alias("d"), "x", "y", "n")
    mixed = [F.xxhash64(F.lit(k), "d", "x", "y").alias(c) for k, c in enumerate("ab", 1)]
    return opened.unionByName(rest).select("conv", "d", *mixed, "n"), ids.select("conv")


def _sections(turns: DataFrame, ids: DataFrame, section: int) -> tuple[DataFrame, bool]:
    """(conv, k, pa, pb, ea, eb, depth, items, last), and whether a conversation has several sections.

    p is the hash of all turns before the section, e of all turns up to its end.
    """
    k = F.expr(f"(d - 1) div {section}").alias("k")
    found = turns.groupBy("conv", k).agg(F.sort_array(F.collect_list(F.struct("d", "a", "b", "n"))).alias("items"), F.bit_xor("a").alias("ea"), F.bit_xor("b").alias("eb"), F.max("d").alias("depth"))
    none = ids.join(found.where("k = 0").select("conv"), "conv", "left_anti")
    none = none.select("conv", F.lit(0).cast("bigint").alias("k"), F.array().cast(dict(found.dtypes)["items"]).alias("items"), *[F.lit(0).cast("bigint").alias(c) for c in ("ea", "eb", "depth")])
    found = cut(found.unionByName(none))
    several = found.where("k > 0").select("conv").distinct()
    if not several.limit(1).count():
        return found.withColumns({"pa": F.lit(0).cast("bigint"), "pb": F.lit(0).cast("bigint"), "last": F.lit(True)}), False
    up = Window.partitionBy("conv").orderBy("k")
    own = found.join(several, "conv", "left_semi").select("conv", "k", "ea", "eb")
    own = own.withColumns({"sa": F.bit_xor("ea").over(up), "sb": F.bit_xor("eb").over(up), "last": F.lead("k").over(up).isNull()})
    own = own.select("conv", "k", F.col("sa").bitwiseXOR(F.col("ea")).alias("pa"), F.col("sb").bitwiseXOR(F.col("eb")).alias("pb"), "last")
    whole = found.join(own, ["conv", "k"], "left").withColumns({"pa": F.coalesce("pa", F.lit(0)), "pb": F.coalesce("pb", F.lit(0)), "last": F.coalesce("last", F.lit(True))})
    return cut(whole.withColumns({"ea": F.col("ea").bitwiseXOR(F.col("pa")), "eb": F.col("eb").bitwiseXOR(F.col("pb"))})), True


def _ends(final: DataFrame) -> DataFrame:
    """(ea, eb, sha) of (ea, eb, conv): the digest of each node's ids, ascending and joined by commas.

    Ids are put in order over tasks and joined to pieces there; a node's pieces pass one task, one at a time.
    """
    reachable(final.sparkSession)

    def pieces(batches):
        for b in batches:
            a, e, conv = (b.column(i).to_numpy() for i in range(3))
            if len(a):
                new = np.flatnonzero((a[1:] != a[:-1]) | (e[1:] != e[:-1])) + 1
                edges = [0, *new.tolist(), len(a)]
                cuts = [i for x, y in zip(edges[:-1], edges[1:], strict=True) for i in range(x, y, IDS)]
                texts = [",".join(map(str, conv[i:j].tolist())) for i, j in zip(cuts, [*cuts[1:], len(a)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(a[cuts]), pa.array(e[cuts]), pa.array(conv[cuts]), pa.array(texts, pa.string())], names=["ea", "eb", "conv", "ids"])

    def digests(batches):
        at, digest = None, None
        for b in batches:
            out = []
            for a, e, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if at == (a, e):
                    digest.update(b",")
                else:
                    if at:
                        out.append((*at, digest.hexdigest()))
                    at, digest = (a, e), hashlib.sha256()
                digest.update(text.encode())
            yield made(out)
        if at:
            yield made([(*at, digest.hexdigest())])

    def made(rows):
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["ea", "eb", "sha"])

    dealt = final.select("ea", "eb", "conv").repartitionByRange(partitions(final.sparkSession), "ea", "eb", "conv").sortWithinPartitions("ea", "eb", "conv")
    joined = dealt.mapInArrow(pieces, "ea bigint, eb bigint, conv bigint, ids string")
    return joined.repartition("ea", "eb").sortWithinPartitions("ea", "eb", "conv").mapInArrow(digests, "ea bigint, eb bigint, sha string")


class _Rows:
    """A partition's sorted rows as arrays: turns flat, depths absolute."""

    def __init__(self, table: pa.Table, left: int, right: int):
        own = {c: table.column(c).to_numpy() for c in ("k", "pa", "pb", "depth", "n", "conv", "goes", "leaves", "saved", "children")}
        items = table.column("items").combine_chunks()
        items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
        offsets = items.offsets.to_numpy()
        flat = items.values.slice(offsets[0], offsets[-1] - offsets[0])
        self.__dict__.update(own)
        self.size = len(self.k)
        self.off = offsets - offsets[0]
        self.m = np.diff(self.off)
        self.base = self.depth - self.m
        a, b, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        self.xa, self.xb = (np.concatenate([[0], np.bitwise_xor.accumulate(x)]) if len(x) else np.zeros(1, np.int64) for x in (a, b))
        self.upto = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        self.total = self.upto[self.off[1:]] - self.upto[self.off[:-1]]
        self.shas = table.column("sha").to_pylist()
        self.above = table.column("above").to_pylist()
        # The common prefix of each row and the one before it; -1 under different roots.
        same = (self.k[1:] == self.k[:-1]) & (self.pa[1:] == self.pa[:-1]) & (self.pb[1:] == self.pb[:-1])
        least = np.minimum(self.m[1:], self.m[:-1])
        start = np.concatenate([[0], np.cumsum(least)])
        inside = np.arange(start[-1]) - np.repeat(start[:-1], least)
        x, y = np.repeat(self.off[:-2], least) + inside, np.repeat(self.off[1:-1], least) + inside
        common = least.copy()
        differs = np.flatnonzero((a[x] != a[y]) | (b[x] != b[y]))
        pair = np.searchsorted(start, differs, "right") - 1
        np.minimum.at(common, pair, inside[differs])
        self.lcp = np.concatenate([[left], np.where(same, self.base[1:] + common, -1)])
        self.next = np.append(self.lcp[1:], right)
        self.leaf = (self.next < self.depth) & (self.goes == 0)
        self.low = np.maximum(self.lcp, np.where(self.k > 0, self.base, -1))  # the deepest node that an earlier row owns
        self.owned = self.total - self.length(np.arange(self.size), np.maximum(self.low, self.base))

    def length(self, row, depth):
        """Code points of a row's turns in its section up to a depth."""
        return self.upto[self.off[row] + np.maximum(depth - self.base[row], 0)] - self.upto[self.off[row]]

    def prefix(self, row: int, depth: int) -> tuple[int, int]:
        at = self.off[row] + depth - self.base[row]
        return int(self.pa[row] ^ self.xa[at] ^ self.xa[self.off[row]]), int(self.pb[row] ^ self.xb[at] ^ self.xb[self.off[row]])


def _forest(r: _Rows, left: int, right: int):
    """Rows of the partition's nodes: closed ones, and the sums of those that reach over its boundaries.

    A component is a run of rows with a common prefix. Yields (open, conv, depth, parent, link, n_convs, n_children, n_leaves,
    saved, sha, index, k, qa, qb, ra, rb); link and index number open nodes, r is the parent's prefix.
    """
    n = r.size
    up = np.arange(n).tolist()
    low, depth, base = r.low.tolist(), r.depth.tolist(), r.base.tolist()
    hi, bottom, members = list(range(n)), list(depth), r.n.tolist()
    gross, owned, leaves = (r.n * r.total + r.saved).tolist(), [0] * n, (r.leaf + r.leaves).tolist()
    least, edges, node = r.conv.tolist(), [0] * n, list(range(n))
    own = r.owned.tolist()
    closed, of_node = [], {}  # of_node: a node's closed record

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def close(x: int, top: int, parent: int | None) -> None:
        of_node[node[x]] = len(closed)
        closed.append((x, hi[x], top, bottom[x], members[x], gross[x] - owned[x], leaves[x], least[x], edges[x], parent))

    inner = np.flatnonzero(r.lcp[1:] > np.where(r.k[1:] > 0, r.base[1:], -1)) + 1
    made = n
    for e in inner[np.argsort(-r.lcp[inner], kind="stable")].tolist():
        at, x, y = int(r.lcp[e]), find(e - 1), find(e)
        held = [c for c in (x, y) if bottom[c] == at]
        parent = node[held[0]] if held else made
        made += not held
        count = 1 + sum(edges[c] for c in held)
        for c in (x, y):
            if bottom[c] > at:
                close(c, at + 1, parent)
        up[y] = x
        hi[x], bottom[x], node[x], edges[x] = hi[y], at, parent, count
        members[x] += members[y]
        gross[x] += gross[y]
        owned[x] += owned[y] + own[y]
        leaves[x] += leaves[y]
        least[x] = min(least[x], least[y])
    for x in range(n):
        if up[x] == x:
            close(x, base[x] + 1 if r.k[x] else 0, None)
    index: dict[tuple[int, int], int] = {}
    spans = lambda c, t: c[0] == 0 and t <= left or c[1] == n - 1 and t <= right
    for i, c in enumerate(closed):
        for t in range(c[2], c[3] + 1):
            if not spans(c, t):
                break
            index[i, t] = len(index)
    for i, (lo, end, top, b, w, net, leaf, conv, count, parent) in enumerate(closed):
        c, k = (lo, end), int(r.k[lo])
        floor, whole = low[lo], net - int(r.total[lo])
        for t in range(top, b + 1):
            open_ = spans(c, t)
            before = max(t - 1, base[lo])
            saved = whole - w * int(r.length(lo, before)) + int(r.length(lo, max(floor, before)))
            kids = int(floor <= t) if t < b else count + int(depth[lo] > b and floor <= b) + (int(r.children[lo]) if depth[lo] == b else 0)
            link, above = None, None
            if t > top:
                link, above = index.get((i, t - 1)), conv
            elif parent is not None:
                j = of_node[parent]
                link, above = index.get((j, t - 1)), closed[j][7]
            elif k:
                above = r.above[lo]
            sha = r.shas[lo] if depth[lo] == b == t else None
            q = r.prefix(lo, t) if open_ else (None, None)
            p = r.prefix(lo, t - 1) if open_ and t > base[lo] else (None, None)
            yield open_, conv, t, above, link, w, kids, leaf, saved, sha, index.get((i, t)), k, *q, *p


_NODE = "open boolean, conv bigint, depth bigint, parent bigint, link int, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, sha string, index int, k bigint, qa bigint, qb bigint, ra bigint, rb bigint, part int"


def _bounds(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """For each partition of sorted rows, the depths down to which its first and last nodes reach over its boundaries; -1 for none."""
    reachable(rows.sparkSession)

    def prefixes(batches):
        first = last = None
        for b in batches:
            if b.num_rows:
                first = first or b.slice(0, 1)
                last = b.slice(b.num_rows - 1, 1)
        for opens, b in ((True, first), (False, last)):
            if b is not None:
                x = b.to_pylist()[0]
                qa, qb, d = x["pa"], x["pb"], x["depth"] - len(x["items"])
                out = [(x["part"], opens, x["k"], d, qa, qb)]
                for t in x["items"]:
                    qa, qb, d = qa ^ t["a"], qb ^ t["b"], d + 1
                    out.append((x["part"], opens, x["k"], d, qa, qb))
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], schema=pa.schema([("part", pa.int64()), ("opens", pa.bool_()), ("k", pa.int64()), ("d", pa.int64()), ("qa", pa.int64()), ("qb", pa.int64())]))

    found = cut(rows.select("part", "k", "pa", "pb", "depth", "items").mapInArrow(prefixes, "part bigint, opens boolean, k bigint, d bigint, qa bigint, qb bigint"))
    key = ["k", "d", "qa", "qb"]
    met = found.groupBy(*key).agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    reach = found.join(met, key).groupBy("part").agg(F.max(F.when(F.col("opens") & (F.col("lo") < F.col("part")), F.col("d"))).alias("left"), F.max(F.when(~F.col("opens") & (F.col("hi") > F.col("part")), F.col("d"))).alias("right"))
    return {r["part"]: (-1 if r["left"] is None else r["left"], -1 if r["right"] is None else r["right"]) for r in reach.collect()}


def _mapped(rows: DataFrame, bounds: dict, make, schema: str) -> DataFrame:
    """Rows of make(rows, left, right) for each partition; a partition, not the table, stands in a task."""
    reachable(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(bounds)  # two numbers a partition
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        part = table.column("part")[0].as_py()
        left, right = sent.value.get(part, (-1, -1))
        out = []
        for x in make(_Rows(table, left, right), left, right):
            out.append((*x, part))
            if len(out) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _totals(r: _Rows, left: int, right: int):
    """(k, pa, pb, leaves, saved, children, conv) of each root in a partition, from its own section alone."""
    root = np.flatnonzero(np.append(True, (r.k[1:] != r.k[:-1]) | (r.pa[1:] != r.pa[:-1]) | (r.pb[1:] != r.pb[:-1])))
    sums = [np.add.reduceat(x.astype(np.int64), root) for x in (r.leaf, r.n * r.total - r.owned, r.low <= r.base)]
    least = np.minimum.reduceat(r.conv, root)
    yield from zip(r.k[root].tolist(), r.pa[root].tolist(), r.pb[root].tolist(), *[x.tolist() for x in sums], least.tolist(), strict=True)


def _later(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """rows with the leaves, savings and children that later sections add, and the first id at a section's root (above)."""
    order = [F.col(c) for c in (*_KEY, "items")]
    later = _spread(rows.where("k > 0"), *order)
    totals = _mapped(later, _bounds(later), _totals, "k bigint, pa bigint, pb bigint, leaves bigint, saved bigint, children bigint, conv bigint, part int")
    totals = totals.groupBy(*_KEY).agg(*[F.sum(c).alias(c) for c in ("leaves", "saved", "children")], F.min("conv").alias("conv"))
    path = sections.where("not last").select("conv", F.col("k").alias("j"), "ea", "eb")
    led = totals.select("conv", F.col("k").alias("of"), "leaves", "saved", "children").join(path, "conv").where("j < of and (j = of - 1 or leaves <> 0 or saved <> 0)")
    kids = F.sum(F.when(F.col("j") == F.col("of") - 1, F.col("children")).otherwise(0))
    added = led.groupBy(F.col("j").alias("k"), "ea", "eb").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), kids.alias("children"))
    roots = rows.where("goes > 0").select((F.col("k") + 1).alias("k"), F.col("ea").alias("pa"), F.col("eb").alias("pb"), F.col("conv").alias("above"))
    return rows.drop("leaves", "saved", "children", "above").join(added, ["k", "ea", "eb"], "left").join(roots, _KEY, "left").fillna(0, ["leaves", "saved", "children"])


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", section: int = SECTION) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations; see the module and rebuilt().

    (conv, depth, parent_conv, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); the conv columns are named
    after conv_col. Turns are in order of turn, null first; equal turns in order of a hash of role and text. Null
    roles and texts are empty; rows without a conversation are left out; rows that are alike are turns of
    their own; other columns are ignored; an empty table gives an empty result. Turns are told apart by 128 bits of
    hashes and their texts are not shuffled.
    """
    reachable(conversations.sparkSession)
    col = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    role, text = col(role_col), col(text_col)
    hashes = [F.xxhash64(F.lit(k), role, text).alias(c) for k, c in enumerate("xy", 3)]
    turns = conversations.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), *hashes, F.length(text).cast("bigint").alias("n")).where("conv is not null")
    sections, several = _sections(*rebuilt(turns), section)
    ends = _ends(sections.where("last").select("ea", "eb", "conv"))
    whole = F.count("*").alias("n"), F.min("conv").alias("conv"), F.count_if(~F.col("last")).alias("goes"), F.first("items").alias("items")
    rows = sections.groupBy("k", "pa", "pb", "ea", "eb", "depth").agg(*whole)
    rows = cut(rows.join(ends, ["ea", "eb"], "left").withColumns({c: F.lit(0).cast("bigint") for c in ("leaves", "saved", "children")} | {"above": F.lit(None).cast("bigint")}))
    if several:
        rows = _later(rows, sections)
    dealt = _spread(rows, *[F.col(c) for c in (*_KEY, "items")])
    nodes = cut(_mapped(dealt, _bounds(dealt), _forest, _NODE))
    key = ["k", "depth", "qa", "qb"]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    met = cut(nodes.where("open").groupBy(*key).agg(F.min("conv").alias("conv"), *sums, F.max("sha").alias("sha"), F.first("ra").alias("ra"), F.first("rb").alias("rb"), F.first("parent").alias("parent")))
    above = met.select("k", (F.col("depth") + 1).alias("depth"), F.col("qa").alias("ra"), F.col("qb").alias("rb"), F.col("conv").alias("above"))
    fields = ["conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "sha"]
    merged = met.join(above, ["k", "depth", "ra", "rb"], "left").withColumn("parent", F.coalesce("above", F.when(F.col("k") > 0, F.col("parent")))).select(*fields)
    known = nodes.where("open").select("part", F.col("index").alias("link"), *key).join(met.select(*key, F.col("conv").alias("above")), key).select("part", "link", "above")
    inner = nodes.where("not open").join(known, ["part", "link"], "left").withColumn("parent", F.coalesce("above", "parent")).select(*fields)
    none = F.lit(hashlib.sha256().hexdigest())
    return inner.unionByName(merged).select(F.col("conv").alias(conv_col), "depth", F.col("parent").alias(f"parent_{conv_col}"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("sha", none).alias("ends_sha256"))
