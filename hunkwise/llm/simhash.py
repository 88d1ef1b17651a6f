"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint is the majority of the 64-bit hashes of a text's word shingles. Two fingerprints within ``RADIUS``
differing bits link, and linked texts form components.

Covering LSH: every bit position gets a non-zero vector of GF(2)^3, and each of the seven non-zero vectors v gives one
mask, that of the positions whose vector is not orthogonal to v. Two differing positions span at most two dimensions, so
some v is orthogonal to both, and the mask of that v sees no difference: every pair within the radius shares a key in
some table, with certainty. In a small bucket the members are compared. In a large one (copies of one text lightly
edited) they are not: two members within radius 2 that agree under the mask have a common midpoint, which is one of them
or one free bit away from each, so members are grouped by midpoints. All that share one are within radius 2, at most 28
do, and the work stays linear in the bucket's size.

Defined results: a null or blank text has fingerprint zero and links like any other; equal texts always share a
component; rows without a doc_id count in their component but never name it (a component without any has a null id).
Repeated rows and further columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, free, fresh_name, min_labels, written

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Members of a bucket up to which they are compared with each other.
SMALL_BUCKET = 16
_DIMS = RADIUS + 1


def masks() -> list[int]:
    """The 2^(RADIUS+1)-1 masks, as signed 64-bit integers."""
    vectors = [1 + i % (2**_DIMS - 1) for i in range(64)]
    found = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2**_DIMS)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z lowered, only ASCII white space splits
    if not words:
        return 0
    joined, width = b" ".join(words), min(SHINGLE, len(words))
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    h = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, 8192):
        hashes = np.array([h(joined[s:e], SEED) for s, e in zip(starts[at : min(at + 8192, n)], ends[at + width - 1 :], strict=False)], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, th, fp)`` of every row; ``fp`` is the fingerprint as a signed long, ``th`` the text's XXH64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t.as_py()) for t in b.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made)], names=["doc_id", "th", "fp"])

    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, "doc_id long, th long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints of ``distinct(fp)`` within the radius."""
    found = masks()
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in found])).alias("t", "key"))
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keyed.join(shared, ["t", "key"]), "simhash-buckets")
    small = members.where(F.col("n") <= SMALL_BUCKET)
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS
    pairs = (
        small.alias("x")
        .join(small.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & near)
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    flips = [F.array(*[F.lit(f) for f in [0, *((1 << i) - (1 << 64) if i == 63 else 1 << i for i in range(64) if not m >> i & 1)]]) for m in found]
    middles = members.where(F.col("n") > SMALL_BUCKET).select("t", "fp", F.explode(F.element_at(F.array(*flips), F.col("t") + 1)).alias("flip"))
    middles = middles.select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    stars = middles.groupBy("t", "middle").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)  # 28 at most
    return pairs.union(stars.select("a", F.explode("all").alias("b"))).where("a <> b").distinct()


def _rooted(prints: DataFrame) -> DataFrame:
    """``fp, least, root`` of every distinct fingerprint: its smallest doc_id and its component."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    labels = min_labels(links(nodes), "simhash-labels")
    return nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint (16 hex digits), component_id``."""
    prints = written(fingerprints(docs, id_col, text_col), "simhash-prints")
    rooted = _rooted(prints)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id (rows without an id come last, ties go by a
    hash of the text); its columns are those of ``docs``. Rows are told apart by id and text, so an id that stands on
    different texts stays wherever its row is the first of a component. Of rows that agree in both, one stays.
    """
    prints = written(fingerprints(docs, id_col, text_col), "simhash-prints")
    rooted = _rooted(prints).select("fp", "root")
    place = F.struct(F.col("doc_id").isNull().alias("bare"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("th"))
    keyed = written(prints.groupBy("doc_id", "th", "fp").agg(F.count("*").alias("n")).join(rooted, "fp").select("root", "n", "doc_id", "th", place.alias("place")), "simhash-keyed")
    firsts = keyed.groupBy("root").agg(F.min("place").alias("first"))
    marked = written(keyed.join(firsts, "root").select("doc_id", "th", "n", (F.col("place") == F.col("first")).alias("stays")), "simhash-marked")
    free(prints, keyed)

    def matching(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        d, th = fresh_name(docs, "key_id"), fresh_name(docs, "key_text")
        keys = broadcast_if_small(keys.select(F.col("doc_id").alias(d), F.col("th").alias(th)))
        return rows.join(keys, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(th)), how)

    kept = matching(docs, marked.where(~F.col("stays")), "left_anti")
    again = marked.where(F.col("stays") & (F.col("n") > 1))
    if again.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = matching(kept, again, "left_semi").groupBy(F.col(f"`{id_col}`").alias("d"), F.xxhash64(F.col(f"`{text_col}`")).alias("th")).agg(F.first(row).alias("row")).select("row.*")
    return matching(kept, again, "left_anti").unionByName(one)
