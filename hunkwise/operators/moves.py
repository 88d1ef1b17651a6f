"""Moved code: pairs of hunks of one diff whose removed and added lines match.

Every pair (i < j) of a diff's hunks is scored in both directions, removed lines of one against added lines of the other:
equal lines match first (k-th occurrence with k-th occurrence), the others greedily by insertion-deletion similarity from
``LINE_LEAST`` on; the sum over the longer side's length is the pair's similarity, and the better direction counts.
Pairs from ``PAIR_LEAST`` on are matched one to one, best first.

A pair can't reach ``PAIR_LEAST`` where one side has under that share of the other's lines, so such directions never leave
the join, and equal lines are taken out before any two lines are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.functions.similarity import LineMatcher, greedy_pairs

LINE_LEAST = 0.3
PAIR_LEAST = 0.3
PURE = 0.9


def numbered(lines: str, occ: str) -> Column:
    """Lines as struct(text, occ): the how-manieth of its text each line is."""
    return F.zip_with(lines, occ, lambda x, n: F.struct(x.alias("text"), n.alias("occ")))


def pair_candidates(hunks: DataFrame) -> DataFrame:
    """Directions of hunk pairs that can be similar: ``diff_id, i, j, dir, gone, come``, gone and come being numbered lines."""
    slim = hunks.select("diff_id", "hunk_idx", numbered("removed", "removed_occ").alias("gone"), numbered("added", "added_occ").alias("come"))
    left, right = slim.alias("l"), slim.alias("r")
    possible = lambda a, b: (F.least(F.size(a), F.size(b)) > 0) & (F.least(F.size(a), F.size(b)) >= F.lit(PAIR_LEAST) * F.greatest(F.size(a), F.size(b)))
    forth, back = possible("l.gone", "r.come"), possible("r.gone", "l.come")
    both = left.join(right, (F.col("l.diff_id") == F.col("r.diff_id")) & (F.col("l.hunk_idx") < F.col("r.hunk_idx")) & (forth | back))
    way = lambda n, a, b: F.struct(F.lit(n).alias("dir"), F.col(a).alias("gone"), F.col(b).alias("come"))
    ways = F.filter(F.array(F.when(forth, way(0, "l.gone", "r.come")), F.when(back, way(1, "r.gone", "l.come"))), lambda x: x.isNotNull())
    return both.select(F.col("l.diff_id").alias("diff_id"), F.col("l.hunk_idx").alias("i"), F.col("r.hunk_idx").alias("j"), F.explode(ways).alias("w")).select("diff_id", "i", "j", "w.*")


def exact_matches(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``exact`` (equal lines matched), ``longest``, and gone and come reduced to the lines left."""
    return candidates.select(
        "diff_id", "i", "j", "dir",
        F.greatest(F.size("gone"), F.size("come")).alias("longest"),
        (F.size("gone") - F.size(F.array_except("gone", "come"))).alias("exact"),
        F.array_except("gone", "come").alias("gone"), F.array_except("come", "gone").alias("come"),
    )


def line_matches(exact: DataFrame) -> DataFrame:
    """Greedy matches of the lines left: ``diff_id, i, j, dir, matches, total``; pairs without a match are left out.

    One narrow step: a pair's lines are compared where the pair is, and texts that come again are compared once.
    """
    texts = lambda side: F.transform(side, lambda x: x["text"]).alias(side)
    left = exact.where((F.size("gone") > 0) & (F.size("come") > 0)).select("diff_id", "i", "j", "dir", texts("gone"), texts("come"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = LineMatcher(LINE_LEAST)
        for b in batches:
            found = [score.match(g.as_py(), c.as_py()) for g, c in zip(b.column(4), b.column(5), strict=True)]
            columns = [pa.array([n for n, _ in found], pa.int32()), pa.array([t for _, t in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *columns], names=["diff_id", "i", "j", "dir", "matches", "total"])

    kinds = {f.name: f.dataType.simpleString() for f in left.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("diff_id", "i", "j", "dir"))
    return left.mapInArrow(run, f"{schema}, matches int, total double").where("matches > 0")


def pair_similarity(hunks: DataFrame) -> DataFrame:
    """``diff_id, i, j, similarity`` of all hunk pairs that have any."""
    exact = exact_matches(pair_candidates(hunks))
    sums = ["diff_id", "i", "j", "dir", "longest"]
    alike = exact.select(*sums, F.col("exact").cast("double").alias("part"))
    near = line_matches(exact).select("diff_id", "i", "j", "dir", F.lit(None).cast("int").alias("longest"), F.col("total").alias("part"))
    both = alike.unionByName(near).groupBy("diff_id", "i", "j", "dir").agg(F.max("longest").alias("longest"), F.max(F.when(F.col("longest").isNotNull(), F.col("part"))).alias("exact"), F.max(F.when(F.col("longest").isNull(), F.col("part"))).alias("total"))
    scored = both.select("diff_id", "i", "j", ((F.col("exact") + F.coalesce("total", F.lit(0.0))) / F.col("longest")).alias("s"))
    return scored.groupBy("diff_id", "i", "j").agg(F.max("s").alias("similarity"))


def match_hunks(pairs: DataFrame, hunks: DataFrame) -> DataFrame:
    """One row per move: ``diff_id, move_id, i, j, similarity, move_type, length``.

    Ids count all connected groups of hunks, single ones too, by first appearance: a move's id is its smaller index less
    the number of moves whose larger index comes before.
    """
    listed = pairs.where(F.col("similarity") >= PAIR_LEAST).groupBy("diff_id").agg(F.collect_list(F.struct((-F.col("similarity")).alias("neg"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))).alias("pairs"))
    picked = listed.select("diff_id", greedy_pairs(F.col("pairs")).alias("picked"))
    moves = picked.select("diff_id", "picked", F.explode("picked").alias("p"))
    moves = moves.select("diff_id", (F.col("p.i") - F.size(F.filter("picked", lambda q: q["j"] < F.col("p.i")))).alias("move_id"), F.col("p.i").alias("i"), F.col("p.j").alias("j"), (-F.col("p.neg")).alias("similarity"))
    moves = moves.withColumn("move_type", F.when(F.col("similarity") >= PURE, "pure").otherwise("modified"))
    size = hunks.select("diff_id", F.col("hunk_idx").alias("h"), (F.col("added_count") + F.col("removed_count")).alias("n"))
    at = lambda side, name: size.select(F.col("diff_id"), F.col("h").alias(side), F.col("n").alias(name))
    return moves.join(at("i", "ni"), ["diff_id", "i"]).join(at("j", "nj"), ["diff_id", "j"]).select("diff_id", "move_id", "i", "j", "similarity", "move_type", F.greatest("ni", "nj").alias("length"))


def members(moves: DataFrame) -> DataFrame:
    """``diff_id, hunk_idx, move_id, move_type``: the two hunks of every move."""
    return moves.select("diff_id", F.explode(F.array("i", "j")).alias("hunk_idx"), "move_id", "move_type")


def typed_hunks(hunks: DataFrame, moves: DataFrame) -> DataFrame:
    """``hunks`` with ``hunk_type`` and ``in_move``."""
    m = members(moves).select("diff_id", "hunk_idx", "move_type", F.lit(True).alias("in_move"))
    kind = (
        F.when(F.col("move_type") == "pure", "move")
        .when(F.col("move_type").isNotNull(), "mixed")
        .when((F.col("added_count") > 0) & (F.col("removed_count") == 0), "pure_addition")
        .when((F.col("removed_count") > 0) & (F.col("added_count") == 0), "pure_deletion")
        .otherwise("mixed")
    )
    return hunks.join(m, ["diff_id", "hunk_idx"], "left").withColumns({"hunk_type": kind, "in_move": F.coalesce("in_move", F.lit(False))}).drop("move_type")


def singletons(hunks: DataFrame, moves: DataFrame) -> DataFrame:
    """The hunks that are in no move."""
    return hunks.join(members(moves), ["diff_id", "hunk_idx"], "left_anti")
