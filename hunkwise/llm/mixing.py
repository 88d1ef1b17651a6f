"""Mixing sources to target weights by Pareto order sampling. DataFrame operations only.

Targets: a source's share of all words is its weight's, but at most ``CAP`` times its own words; what lies above is shared
again by weight (water filling, solved in one ordered pass over the sources).

Within a source a document of n words is expected ``min(CAP, c * propensity)`` times, its propensity being the bit length
of n (longer texts are likelier, slowly) and c such that the expected words meet the target. The whole part of that
expectation is taken for certain. The fraction p is an inclusion probability, drawn by Pareto order sampling: documents
are ranked by the odds of a keyed random number over the odds of p, and the smallest are taken until the words of the
sample, whose size is fixed, are reached. As the last one rarely fits, the best-fitting document not taken yet follows if
that brings the sample nearer to its size.

Ranks are cut without sorting a source in one task: a histogram of the ranks finds the bucket in which a source's words
are reached, and only that bucket's rows (one in ``BUCKETS``) are ordered.

Defined results: a null or blank text has size 0 and takes 0; a null source is one source, ordered last; rows that agree
in id and size share their random number and are taken together; reruns agree, since the random number is a keyed digest
of id and size. Further columns don't matter; an empty table gives an empty result. The sources' own totals (a row each)
are the only thing ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, written

CAP = 3
WEIGHTS = (1, 2, 3)
BUCKETS = 1 << 16
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column, seed: str = SEED) -> Column:
    """A number strictly between 0 and 1, fixed by ``parts``."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, cap: int = CAP) -> DataFrame:
    """``totals(source, source_size)`` with ``target``: shares by repeating ``weights`` in code point order, null last."""
    one = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(one) - 1) % len(weights)
    weighted = totals.withColumn("w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), place + 1)).withColumn("most", F.col("source_size") * cap)
    fill = W.orderBy((F.col("most").cast("double") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    wanted = F.sum("source_size").over(W.partitionBy()).cast("double") * F.lit(float(share))
    level = (wanted - F.coalesce(F.sum("most").over(before), F.lit(0)).cast("double")) / F.sum("w").over(after).cast("double")
    levels = weighted.withColumn("level", level).withColumn("full", F.col("most").cast("double") <= F.col("level") * F.col("w"))
    final = F.min(F.when(~F.col("full"), F.struct(F.col("most").cast("double") / F.col("w"), F.col("level")))).over(W.partitionBy())["level"]
    return levels.withColumn("final", final).select(
        "source", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("final") * F.col("w")).alias("target")
    )


def _rates(slim: DataFrame, aims: DataFrame, cap: int) -> DataFrame:
    """``aims`` with ``rate``, the c of each source (null where it takes nothing)."""
    classes = slim.where("size > 0").groupBy("source", "prop").agg(F.sum("size").alias("s")).alias("c")
    classes = classes.join(aims.alias("a"), F.col("c.source").eqNullSafe(F.col("a.source"))).select("a.*", "prop", "s")
    down = W.partitionBy("source").orderBy(F.col("prop").desc())
    capped = F.coalesce(F.sum("s").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("prop") * F.col("s")).over(down.rowsBetween(W.currentRow, W.unboundedFollowing))
    rate = (F.col("target") - F.lit(float(cap)) * capped.cast("double")) / rest.cast("double")
    fits = classes.withColumn("rate", rate).where(F.col("rate") * F.col("prop") <= float(cap))
    best = fits.groupBy("source").agg(F.max_by("rate", "prop").alias("rate")).withColumnRenamed("source", "_s")
    return aims.join(best, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``; ``taken = copies * size``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    slim = slim.withColumn("u", uniform(F.col("doc_id"), F.col("size"), seed=seed)).withColumn("prop", F.length(F.bin("size")).cast("long"))
    slim = written(slim, "mix-sizes")
    aims = written(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "mix-targets")
    rates = written(_rates(slim, aims, cap), "mix-rates")

    times = F.when(F.col("target") >= F.col("source_size").cast("double") * F.lit(float(cap)), F.lit(float(cap)))
    times = times.otherwise(F.least(F.lit(float(cap)), F.coalesce(F.col("rate"), F.lit(0.0)) * F.col("prop")))
    odds = F.col("u") * (F.lit(1.0) - F.col("p"))
    rank = F.when((F.col("p") > 0) & (F.col("size") > 0), odds / (odds + F.col("p") * (F.lit(1.0) - F.col("u"))))
    ranked = (
        slim.alias("s")
        .join(rates.alias("r"), F.col("s.source").eqNullSafe(F.col("r.source")))
        .select("doc_id", F.col("s.source").alias("source"), "size", "u", "source_size", "target", times.alias("times"))
        .withColumn("sure", F.floor("times").cast("long"))
        .withColumn("p", F.col("times") - F.col("sure").cast("double"))
        .withColumn("rank", rank)
        .withColumn("bucket", F.floor(F.col("rank") * F.lit(float(BUCKETS))).cast("int"))
    )
    histogram = ranked.groupBy("source", "bucket").agg(F.sum(F.when(F.col("bucket").isNotNull(), F.col("size"))).alias("words"), F.sum(F.col("sure") * F.col("size")).alias("sure"), F.first("target").alias("target"))
    histogram = histogram.withColumn("left", F.col("target") - F.sum("sure").over(W.partitionBy("source")).cast("double")).where("bucket is not null")
    run = W.partitionBy("source").orderBy("bucket")
    cuts = histogram.withColumn("before", F.sum("words").over(run) - F.col("words")).where(F.col("before") <= F.col("left"))
    cuts = written(cuts.groupBy("source").agg(F.max_by(F.struct("bucket", "before", "left"), "bucket").alias("x")).select("source", "x.*"), "mix-cuts")

    at = ranked.where("bucket is not null").alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.bucket") == F.col("c.bucket"))).select("d.source", "d.rank", "d.size", "c.before", "c.left")
    within = at.withColumn("upto", F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("rank").rangeBetween(W.unboundedPreceding, W.currentRow)))
    last = within.where(F.col("upto") <= F.col("left")).groupBy("source").agg(F.max("rank").alias("last"), F.max("upto").alias("upto")).withColumnRenamed("source", "_s")
    cuts = cuts.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("cut_source"), F.col("bucket").alias("cut"), "last", (F.col("left") - F.coalesce("upto", "before").cast("double")).alias("gap"))
    cuts = written(cuts, "mix-gaps")

    drawn = (F.col("bucket") < F.col("cut")) | ((F.col("bucket") == F.col("cut")) & (F.col("rank") <= F.coalesce("last", F.lit(-1.0))))
    marked = ranked.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").withColumn("drawn", F.coalesce(drawn, F.lit(False)))
    spare = marked.where("rank is not null and not drawn").groupBy("source", "gap").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "rank", "size")).alias("x")).select(F.col("source").alias("s"), "gap", "x.off", "x.rank", F.col("x.size").alias("size"))
    alike = ranked.alias("d").join(spare.alias("e"), F.col("d.source").eqNullSafe(F.col("e.s")) & (F.col("d.rank") == F.col("e.rank")) & (F.col("d.size") == F.col("e.size")))
    extra = alike.groupBy(F.col("e.s").alias("s"), F.col("e.rank").alias("extra_rank"), F.col("e.size").alias("extra_size"), "e.gap").agg(F.count("*").alias("n"))
    extra = written(extra.where(F.abs(F.col("gap") - (F.col("n") * F.col("extra_size")).cast("double")) < F.col("gap")).select(F.col("s").alias("extra_source"), "extra_rank", "extra_size"), "mix-extra")
    more = (F.col("rank") == F.col("extra_rank")) & (F.col("size") == F.col("extra_size"))
    full = marked.join(extra, F.col("source").eqNullSafe(F.col("extra_source")), "left")
    copies = F.col("sure") + (F.col("drawn") | F.coalesce(more, F.lit(False))).cast("long")
    return full.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


#: The same for DuckDB.
SQL = """
WITH slim AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {docs}
), keyed AS (
  SELECT *, (CAST(CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(size AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5e0) / 4503599627370496e0 AS u,
    CAST(length(bin(size)) AS BIGINT) AS prop FROM slim
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source
), weighted AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w, 3 * source_size AS most FROM totals
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(most) OVER (ORDER BY CAST(most AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(w) OVER (ORDER BY CAST(most AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM weighted
), aims AS (
  SELECT source, source_size, CASE WHEN CAST(most AS DOUBLE) <= level * w THEN CAST(most AS DOUBLE)
    ELSE w * (SELECT arg_min(level, CAST(most AS DOUBLE) / w) FROM levels WHERE NOT CAST(most AS DOUBLE) <= level * w) END AS target FROM levels
), classes AS (
  SELECT source, prop, CAST(sum(size) AS BIGINT) AS s FROM keyed WHERE size > 0 GROUP BY ALL
), cands AS (
  SELECT c.source, prop, (target - 3e0 * CAST(coalesce(sum(s) OVER (PARTITION BY c.source ORDER BY prop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(prop * s) OVER (PARTITION BY c.source ORDER BY prop DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rate
  FROM classes c JOIN aims a ON c.source IS NOT DISTINCT FROM a.source
), rates AS (
  SELECT a.*, x.rate FROM aims a LEFT JOIN (SELECT source, arg_max(rate, prop) AS rate FROM cands WHERE rate * prop <= 3e0 GROUP BY source) x ON a.source IS NOT DISTINCT FROM x.source
), timed AS (
  SELECT k.*, source_size, target, CASE WHEN target >= CAST(source_size AS DOUBLE) * 3e0 THEN 3e0 ELSE least(3e0, coalesce(rate, 0e0) * prop) END AS times
  FROM keyed k JOIN rates r ON k.source IS NOT DISTINCT FROM r.source
), parted AS (
  SELECT *, CAST(floor(times) AS BIGINT) AS sure, times - floor(times) AS p FROM timed
), ranked AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN u * (1e0 - p) / (u * (1e0 - p) + p * (1e0 - u)) END AS rank FROM parted
), run AS (
  SELECT *, target - CAST(sum(sure * size) OVER (PARTITION BY source) AS DOUBLE) AS rest,
    sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank ASC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ranked
), marked AS (
  SELECT *, rank IS NOT NULL AND upto <= rest AS drawn FROM run
), gaps AS (
  SELECT source, max(rest) - CAST(coalesce(max(CASE WHEN drawn THEN upto END), 0) AS DOUBLE) AS gap FROM marked GROUP BY source
), spare AS (
  SELECT m.source, gap, min({{'off': abs(gap - size), 'rank': rank, 'size': size}}) AS x FROM marked m JOIN gaps g ON m.source IS NOT DISTINCT FROM g.source WHERE rank IS NOT NULL AND NOT drawn GROUP BY ALL
), extra AS (
  SELECT e.source, e.x.rank AS rank, e.x.size AS size FROM spare e JOIN ranked d ON d.source IS NOT DISTINCT FROM e.source AND d.rank = e.x.rank AND d.size = e.x.size
  GROUP BY e.source, e.x.rank, e.x.size, gap HAVING abs(gap - CAST(count(*) * e.x.size AS DOUBLE)) < gap
), final AS (
  SELECT m.*, m.sure + CAST(m.drawn OR e.rank IS NOT NULL AS BIGINT) AS copies
  FROM marked m LEFT JOIN extra e ON m.source IS NOT DISTINCT FROM e.source AND m.rank = e.rank AND m.size = e.size
)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM final
"""
