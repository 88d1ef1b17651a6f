"""Benchmark decontamination: SimHash of item-sized windows. DataFrame operations only.

A document holds a benchmark item if some window of the item's size holds at least ``LEAST`` of the item's five-word
shingles by weight, repeats included. A shingle weighs 1 + floor(log2(documents / documents that have it)); the counts
are over all documents. Shingles of no item have no weight, in windows as in items: foreign words neither enter the
similarity nor turn a fingerprint, however rare they are.

Windows: moving a window to the first shingle of the item in it loses nothing of the item, so the windows that begin with
an item's shingle and have that item's size are all there need be. Of these only windows go on whose weighty shingles add
up to ``LEAST`` of the lightest such item. Windows that agree in content are fingerprinted once, however many documents
share them. Fingerprints add up +-sqrt(weight) for each bit, so the cosine of a window and an item is their weighted
similarity (over the geometric mean of their weights), and two bits differ with probability arccos(cosine) / pi.

Candidates: ``RADIUS`` is the mean number of differing bits at the limit and three deviations; the 64 bits are cut into
RADIUS + 1 blocks, so every pair within the radius agrees in a whole block. Windows and items are joined by block, the
block's bits, the size and the window's first shingle, and the exact weighted similarity decides about pairs within the
radius.

Words are runs of anything but ASCII white space, in lower case. An item of fewer than five words is one shingle of all
its words. Defined results: null or blank texts and items match nothing; items that agree in words match separately, rows
of ``benchmark`` that agree in id and text are one; rows of documents that agree in id and text count as one document; of
a document's windows for one item the most similar counts (then the first). Further columns don't matter; empty tables
give an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, free, fresh_name, written

SHINGLE = 5
LEAST = 0.8
BITS = 64


def radius(least: float) -> int:
    """Differing bits of two fingerprints whose cosine is ``least``: the mean and three standard deviations."""
    p = math.acos(least) / math.pi
    return min(BITS - 1, math.ceil(BITS * p + 3 * math.sqrt(BITS * p * (1 - p))))


RADIUS = radius(LEAST)


def blocks(within: int) -> list[int]:
    """Masks, as signed longs, of ``within + 1`` runs of bits; two fingerprints within the radius agree under one."""
    edges = [BITS * i // (within + 1) for i in range(within + 2)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(ws: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; ``ws`` must be a column, not an expression."""
    each = F.transform(ws, lambda w, i: F.when(i + size <= F.size(ws), F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, size)])))
    return F.slice(each, 1, F.greatest(F.size(ws) - size + 1, F.lit(0)))


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``ik, item_id, n, size, sh``: a key of its own, words, shingle size and shingles of every item."""
    read = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").alias("text")).distinct()
    read = read.select("item_id", F.xxhash64("item_id", F.lit("|"), "text").alias("ik"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    cases = [F.when(F.size("ws") == k, shingles(F.col("ws"), k)) for k in range(1, SHINGLE)]
    return read.select("ik", "item_id", F.size("ws").alias("n"), F.least(F.size("ws"), F.lit(SHINGLE)).alias("size"), F.coalesce(*cases, shingles(F.col("ws"), SHINGLE)).alias("sh"))


def _simhash(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by, fp``: weighted SimHash of rows ``(by, h, w, times)``, as a signed long; ties are 0."""
    each = rows.select(*by, "h", (F.round(F.sqrt(F.col("w").cast("double")) * 1000).cast("long") * F.col("times")).alias("amount"))
    up = [F.expr(f"sum(if(shiftright(h, {b}) & 1L = 1L, amount, -amount)) as b{b}") for b in range(BITS)]  # text: a Column of this size takes seconds to build
    bits = " | ".join(f"if(b{b} > 0, shiftleft(1L, {b}), 0L)" for b in range(BITS))
    return each.groupBy(*by).agg(*up).select(*by, F.expr(bits).alias("fp"))


def _hits(docs: DataFrame, known: DataFrame, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, th, size, pos, h``: the places in documents at which an item's shingle stands; one scan for all sizes."""
    text = F.col(f"`{text_col}`")
    marked = docs.where(text.isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), words(text).alias("ws"))

    def placed(k: int) -> Column:
        return F.transform(shingles(F.col("ws"), k), lambda h, i: F.struct(F.lit(k).alias("size"), i.alias("pos"), h.alias("h")))

    each = marked.select("doc_id", "th", F.explode(F.concat(*[placed(k) for k in sizes])).alias("x")).select("doc_id", "th", "x.*")
    return each.join(broadcast_if_small(known), ["size", "h"], "left_semi").select("doc_id", "th", "size", "pos", "h")


def _windows(hits: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, th, size, n, start, hs``: windows heavy enough for an item, with the shingles they hold in order.

    A document's places are one array (the document itself is one row); ``known(size, h, w, ns)`` has a shingle's weight
    and, for each size of the items that have it, what a window of that size must weigh.
    """
    weighed = hits.join(broadcast_if_small(known), ["size", "h"]).select("doc_id", "th", "size", F.struct("pos", "h", "w", "ns").alias("x"))
    per_doc = weighed.groupBy("doc_id", "th", "size").agg(F.array_sort(F.collect_set("x")).alias("all"))

    def inside(at: Column, pos: Column, n: Column) -> Column:
        places = n - F.col("size") + 1
        return F.filter(F.slice("all", at + 1, places), lambda z: z["pos"] < pos + places)

    def heavy(x: Column, i: Column) -> Column:
        return F.filter(x["ns"], lambda y: F.aggregate(inside(i, x["pos"], y["n"]), F.lit(0).cast("long"), lambda s, z: s + z["w"]) >= y["need"])

    starts = F.filter(F.transform("all", lambda x, i: F.struct(i.alias("i"), x["pos"].alias("pos"), heavy(x, i).alias("ns"))), lambda x: F.size(x["ns"]) > 0)
    found = F.transform("starts", lambda k: F.transform(k["ns"], lambda y: F.struct(k["pos"].alias("start"), y["n"].alias("n"), F.transform(inside(k["i"], k["pos"], y["n"]), lambda z: z["h"]).alias("hs"))))
    return per_doc.withColumn("starts", starts).where(F.size("starts") > 0).select("doc_id", "th", "size", F.explode(F.flatten(found)).alias("v")).select("doc_id", "th", "size", "v.n", "v.start", "v.hs")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """One row per document and item it holds: ``doc_id, th, item_id, start, n_words, similarity, hamming``."""
    within = radius(least)
    items = written(_items(benchmark, item_col, item_text), "leaks-items")
    parts = written(items.select("ik", "n", "size", F.explode("sh").alias("h")).groupBy("ik", "n", "size", "h").agg(F.count("*").alias("times")), "leaks-item-shingles")
    sizes = [k for k in range(1, SHINGLE + 1) if not items.where(F.col("size") == k).isEmpty()]
    hits = written(_hits(docs, parts.select("size", "h").distinct(), sizes or [SHINGLE], id_col, text_col), "leaks-hits")

    total = max(1, docs.count())
    df = hits.groupBy("size", "h").agg(F.count_distinct("th", F.coalesce("doc_id", F.lit(-1)))).toDF("size", "h", "df")
    rarest = int(total).bit_length()
    power = F.lit(0)  # floor(log2(total / df)): how often df can double without passing total
    for k in range(1, rarest):
        power = power + F.when(F.col("df") * (1 << k) <= total, 1).otherwise(0)
    weights = df.select("size", "h", (power + 1).cast("long").alias("w"))
    held = written(parts.join(weights, ["size", "h"], "left").select("ik", "n", "size", "h", "times", F.coalesce("w", F.lit(rarest).cast("long")).alias("w")), "leaks-held")
    whole = held.groupBy("ik").agg(F.sum(F.col("times") * F.col("w")).alias("whole"))
    need = held.join(whole, "ik").groupBy("size", "h", "n").agg(F.first("w").alias("w"), F.ceil(F.min("whole") * F.lit(least) - 1e-6).cast("long").alias("need"))
    known = written(need.groupBy("size", "h").agg(F.first("w").alias("w"), F.array_sort(F.collect_list(F.struct("n", "need"))).alias("ns")), "leaks-known")

    content = ["size", "n", "c1", "c2"]
    windows = _windows(hits, known).withColumns({"c1": F.xxhash64("hs"), "c2": F.xxhash64(F.lit(1), F.col("hs"))})
    windows = written(windows, "leaks-windows")
    free(parts, hits)
    contents = windows.groupBy(*content).agg(F.first("hs").alias("hs"))
    inside = contents.select(*content, F.element_at("hs", 1).alias("first"), F.explode("hs").alias("h")).groupBy(*content, "first", "h").agg(F.count("*").alias("times"))
    inside = written(inside.join(known.select("size", "h", "w"), ["size", "h"]), "leaks-contents")

    masks = blocks(within)
    in_block = lambda fp: F.posexplode(F.array(*[fp.bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("block", "bits")
    prints = written(_simhash(inside, [*content, "first"]), "leaks-prints")
    asked = written(_simhash(held, ["ik", "n", "size"]), "leaks-asked")
    begins = held.select("ik", F.col("h").alias("first")).join(asked, "ik")
    x = prints.select(*content, "first", "fp", in_block(F.col("fp"))).alias("x")
    y = begins.select("ik", "n", "size", "first", "fp", in_block(F.col("fp"))).alias("y")
    apart = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    first_block = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m).cast("long")) == 0, k) for k, m in enumerate(masks)])  # a pair counts in the first block that it shares
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("block", "bits", "first", "n", "size")]
    near = x.join(y, same[0] & same[1] & same[2] & same[3] & same[4] & (F.bit_count(apart) <= within) & (first_block == F.col("x.block")))
    near = written(near.select("y.ik", *[f"x.{c}" for c in content], F.bit_count(apart).alias("hamming")), "leaks-near")

    mine = held.select("ik", "size", "h", F.col("times").alias("asked"))
    common = near.join(inside, content).join(mine, ["ik", "size", "h"]).groupBy("ik", *content, "hamming").agg(F.sum(F.least("times", "asked") * F.col("w")).alias("common"))
    scored = common.join(whole, "ik").where(F.col("common") >= F.lit(least) * F.col("whole") - 1e-6)
    scored = written(scored.join(items.select("ik", "item_id"), "ik").select("ik", "item_id", *content, "hamming", (F.col("common") / F.col("whole")).alias("similarity")), "leaks-scored")
    best = F.max_by(F.struct("start", "n", "similarity", "hamming"), F.struct("similarity", -F.col("start")))
    found = windows.drop("hs").join(broadcast_if_small(scored), content).groupBy("doc_id", "th", "ik", "item_id").agg(best.alias("x"))
    return found.select("doc_id", "th", "item_id", F.col("x.start").alias("start"), F.col("x.n").alias("n_words"), F.col("x.similarity").alias("similarity"), F.col("x.hamming").alias("hamming"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item: ``doc_id, item_id, start, n_words, similarity, hamming``."""
    return leaks(docs, benchmark).select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"), F.round("similarity", 6).alias("similarity"), F.col("hamming").cast("long").alias("hamming"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item; the columns of ``docs``, whatever their names."""
    d, th = fresh_name(docs, "key_id"), fresh_name(docs, "key_text")
    lost = written(leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(d), F.col("th").alias(th)).distinct(), "leaks-lost")
    return docs.join(broadcast_if_small(lost), F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(th)), "left_anti")
