"""Ranked lexical search by pipelined term partitioning.

Documents are indexed in blocks: one row for each term of a block, with the term's
documents, counts and document lengths as packed arrays. Terms are owned by STAGES owners,
rarest terms first. Bundles of items go from owner to owner; for each block of documents a
bundle meets the owner's postings in a cogroup, which adds whole-number contributions to the
items' sparse accumulators. After each owner the scores found so far give every item a
score that its last result is sure to reach; what cannot reach it with all terms still to
come is let go, so the frequent terms of the last owners touch few documents, and no result
is lost.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, reachable, slices
from tesserae.llm.sharding import numbered

#: Documents and postings of a block, and items of a bundle.
BLOCK_DOCS, BLOCK_POSTINGS, BUNDLE_ITEMS = 4096, 300_000, 64
#: Shares of all postings up to which each owner but the last has its terms.
SHARES = (0.02, 0.1, 0.35)
STAGES = len(SHARES) + 1
#: Distinct terms of items, in characters, that may be sent to every task; of more, all terms are indexed.
SENT_CHARS = 16 << 20
#: Parts of a group whose best rows are chosen first.
PARTS = 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)) + bytes(range(128, 256))


def terms(text: Column) -> Column:
    """A text's terms in order, repeats included."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _SEPARATORS), lambda x: x != "")


def _posted(ids: list, counts: list[Counter], sizes: list[int]):
    """A block's rows: one for each term, and one with its ids and totals. Places follow the ids' order."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i]))
    lists: dict[bytes, tuple[list[int], list[int]]] = {}
    for at, i in enumerate(order):
        for term, tf in counts[i].items():
            docs, tfs = lists.setdefault(term, ([], []))
            docs.append(at)
            tfs.append(tf)
    lengths = np.array(sizes, np.uint32)[order]
    yield None, b"", b"", lengths.tobytes(), int((lengths > 0).sum()), int(lengths.sum(dtype=np.int64)), 0, [ids[i] for i in order]
    for term, (docs, tfs) in lists.items():
        own = lengths[docs]
        yield term.decode(), np.array(docs, "<u2").tobytes(), np.array(tfs, "<u4").tobytes(), own.tobytes(), len(docs), max(tfs), int(own.min()), None


def index(docs: DataFrame, wanted: list[str] | None, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(block, term, docs, tfs, sizes, n, most, least, ids) of all documents.

    A term's row has its places in the block, counts and documents' lengths, packed, how
    many they are, the largest count and the least length. The row without a term has
    the block's ids, its documents with a term (n) and their terms (most). With wanted, only
    these terms have rows; lengths count all terms.
    """
    spark = docs.sparkSession
    reachable(spark)
    kind = dict(docs.dtypes)[id_col]
    names = ["block", "term", "docs", "tfs", "sizes", "n", "most", "least", "ids"]
    schema = f"block bigint, term string, docs binary, tfs binary, sizes binary, n bigint, most bigint, least bigint, ids array<{kind}>"
    sent = spark.sparkContext.broadcast(None if wanted is None else frozenset(x.encode() for x in wanted))

    def run(batches):
        from pyspark import TaskContext

        kept, block = sent.value, TaskContext.get().partitionId() << 32
        ids, counts, sizes, postings = [], [], [], 0

        def rows():
            columns = list(zip(*_posted(ids, counts, sizes), strict=True))
            for at in range(0, len(columns[0]), 2000):
                part = [c[at : at + 2000] for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(part[0]), pa.int64()), *[pa.array(list(c), t) for c, t in zip(part, types, strict=True)]], names=names)

        for batch in slices(batches, 1):
            types = [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(batch.column(0).type)]
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.encode().translate(_TABLE).split() if text else []
                found = Counter(words if kept is None else filter(kept.__contains__, words))
                ids.append(own)
                counts.append(found)
                sizes.append(len(words))
                postings += len(found)
                if len(ids) >= block_docs or postings >= BLOCK_POSTINGS:
                    yield from rows()
                    block += 1
                    ids, counts, sizes, postings = [], [], [], 0
        if ids:
            yield from rows()

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)


def _best(rows: DataFrame, keys: list[str], value: str, top: int) -> DataFrame:
    """The `top` least of the elements of value, an array, over all rows of each key; in two steps, so that no task meets all."""
    least = F.slice(F.sort_array(F.flatten(F.collect_list(value))), 1, top).alias(value)
    return rows.groupBy(*keys, F.pmod("block", F.lit(PARTS)).alias("__part")).agg(least).groupBy(*keys).agg(least)


def _stage(last: bool, top: int, documents: int, total: int):
    """Adds an owner's contributions to a bundle's accumulators over one block."""
    names = ["g", "block", "q", "docs", "scores", "best"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        sums: dict[int, tuple] = {}
        size = 1 + max([0, *(int(np.frombuffer(x, "<u2").max()) for t in (left, right) for x in t.column("docs").to_pylist())])

        def of(q: int, floor: int, before: int, after: int):
            if q not in sums:
                sums[q] = (np.zeros(size, np.int64), np.zeros(size, bool), floor, before, after)
            return sums[q]

        if left.num_rows:
            for q, docs, scores, floor, before, after in zip(*[left.column(c).to_pylist() for c in ("q", "docs", "scores", "floor", "before", "after")], strict=True):
                at = np.frombuffer(docs, "<u2")
                scored, seen, *_ = of(q, floor, before, after)
                scored[at] = np.frombuffer(scores, "<i8")
                seen[at] = True
        if right.num_rows:
            for docs, tfs, sizes, who in zip(*[right.column(c).to_pylist() for c in ("docs", "tfs", "sizes", "who")], strict=True):
                at, tf = np.frombuffer(docs, "<u2"), np.frombuffer(tfs, "<u4").astype(np.int64)
                m = 75 + (25 * np.frombuffer(sizes, "<u4").astype(np.int64) * documents) // total
                share = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
                for x in who:
                    scored, seen, floor, before, _ = of(x["q"], x["floor"], x["before"], x["after"])
                    if before >= floor:  # a document that is not held yet can still be among the best
                        scored[at] += x["c"] * share
                        seen[at] = True
                    else:
                        held = seen[at]
                        scored[at[held]] += x["c"] * share[held]
        out = []
        for q, (scored, seen, floor, _, after) in sums.items():
            at = np.flatnonzero(seen & (scored > 0) & (scored + after >= floor))
            if len(at):
                order = at[np.argsort(-scored[at], kind="stable")[:top]]
                kept = order if last else at
                out.append((*[k.as_py() for k in key], q, kept.astype("<u2").tobytes(), scored[kept].astype("<i8").tobytes(), (-scored[order]).tolist()))
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def search(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_docs: int = BLOCK_DOCS, bundle_items: int = BUNDLE_ITEMS) -> DataFrame:
    """(item, rank, id, score): each item's `top` documents with the highest scores above 0.

    Terms are runs of letters, digits and signs beyond ASCII, with A-Z in lower case. Equal
    scores are put in order by id. Null texts have no terms; a null id or item is one of its own
    and the least; rows of items that are alike are one item; rows of docs that are alike are
    documents of their own. Other columns are ignored; an empty table on either side
    gives an empty result. A block's sums for a bundle, not the table's, stand in a task.
    """
    spark = docs.sparkSession
    reachable(spark)
    asked = items.select(F.col(f"`{item_col}`").alias("item"), F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("text")).distinct()
    asked, _ = numbered(asked, ["item", "text"])
    asked = cut(asked.withColumnRenamed("__row", "q").withColumn("g", F.expr(f"q div {bundle_items}")))
    each = cut(asked.select("q", "g", F.explode(terms(F.col("text"))).alias("term")).groupBy("q", "g", "term").agg(F.count("*").alias("c")))
    distinct = each.select("term").distinct()
    few = (distinct.agg(F.sum(F.length("term"))).first()[0] or 0) <= SENT_CHARS
    postings = cut(index(docs, [r.term for r in distinct.collect()] if few else None, id_col, text_col, block_docs))
    documents, total = postings.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("most"), F.lit(0))).first()
    kind = dict(docs.dtypes)[id_col]
    if not total:
        return spark.createDataFrame([], f"`{item_col}` {dict(asked.dtypes)['item']}, rank int, `{id_col}` {kind}, score bigint")
    # What one occurrence adds at most, from the largest count and the least length of each block.
    ceiling = F.expr(f"(1000000000 * most) div (1000 * most + 12 * (75 + (25 * least * {documents}) div {total}))")
    weight = F.floor(F.lit(1000) * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("bigint")
    known = postings.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"), F.max(ceiling).alias("ceiling")).withColumn("w", weight).where("w > 0")
    known = cut(known.join(distinct, "term"))
    volume = known.groupBy("w").agg(F.sum("df").alias("n")).orderBy(F.desc("w")).collect()  # weights are whole numbers below 1000 ln(2 N + 2)
    upto, all_, cuts = 0, sum(r.n for r in volume), []
    for r in volume:
        upto += r.n
        if len(cuts) < len(SHARES) and upto >= SHARES[len(cuts)] * all_:
            cuts.append(r.w)
    owner = sum((F.when(F.col("w") < c, 1).otherwise(0) for c in cuts), F.lit(0))
    each = cut(each.join(known, "term").select("q", "g", "term", (F.col("c") * F.col("w")).alias("c"), (F.col("c") * F.col("w") * F.col("ceiling")).alias("most"), owner.alias("owner")))
    sums = [F.coalesce(F.sum(F.when(F.col("owner") >= s, F.col("most"))), F.lit(0)).alias(f"from{s}") for s in range(STAGES + 1)]
    limits = cut(each.groupBy("q").agg(*sums))
    bundles, floors = None, None
    for s in range(STAGES):
        own = limits.select("q", F.col(f"from{s}").alias("before"), F.col(f"from{s + 1}").alias("after"))
        own = own.join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(1))) if floors else own.withColumn("floor", F.lit(1).cast("bigint"))
        own = cut(own)
        who = F.collect_list(F.struct("q", "c", "floor", "before", "after")).alias("who")
        need = each.where(F.col("owner") == s).join(own, "q").groupBy("g", "term").agg(who)
        right = postings.where("term is not null").select("block", "term", "docs", "tfs", "sizes").join(need, "term")
        left = bundles.join(own, "q") if bundles else spark.range(0).selectExpr("id AS g", "id AS block", "id AS q", "X'' AS docs", "X'' AS scores", "id AS before", "id AS after", "id AS floor")
        fused = left.groupBy("g", "block").cogroup(right.groupBy("g", "block"))
        bundles = cut(fused.applyInArrow(_stage(s == STAGES - 1, top, documents, total), "g bigint, block bigint, q bigint, docs binary, scores binary, best array<bigint>"))
        floors = _best(bundles, ["q"], "best", top).select("q", F.when(F.size("best") == top, -F.element_at("best", -1)).otherwise(1).alias("floor"))
    return _ranked(bundles, postings, asked, top, item_col, id_col)


def _ranked(bundles: DataFrame, postings: DataFrame, asked: DataFrame, top: int, item_col: str, id_col: str) -> DataFrame:
    """The best documents of each item, with their ids and ranks."""
    reachable(bundles.sparkSession)
    places = bundles.select("q", "block", F.posexplode("best").alias("k", "minus"), "docs")
    at = F.conv(F.concat(*[F.hex(F.substring("docs", 2 * F.col("k") + i, 1)) for i in (2, 1)]), 16, 10).cast("int")
    ids = postings.where("term is null").select("block", "ids")
    found = places.withColumn("at", at).join(ids, "block").select("q", "block", F.array(F.struct("minus", F.get("ids", "at").alias("id"))).alias("best"))
    best = _best(found, ["q"], "best", top).select("q", F.posexplode("best").alias("k", "b"))
    return best.join(asked, "q").select(F.col("item").alias(item_col), (F.col("k") + 1).cast("int").alias("rank"), F.col("b.id").alias(id_col), (-F.col("b.minus")).alias("score"))
