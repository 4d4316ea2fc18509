"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. Whole copies that the target covers are certain; what is left is drawn without
replacement: each document gets a random number u from its id and an inclusion probability p, and documents are taken
in order of (u / (1 - u)) / (p / (1 - p)), least first, until their words reach the rest of the target. Longer
documents have higher inclusion odds, by their size over their source's mean within [1/2, 2].

A source may hold a third of all rows, so no task sorts a source. Ranks fall into ``BINS`` bins by rank / (1 + rank);
words are summed by source and bin before the shuffle, the bin where the target is reached is found on those sums, and
only that one bin's documents are ordered one by one.

Defined cases: null text has size 0; null source is a source of its own, after the others; a document of size 0 takes
0; repeated rows are drawn one by one, ties by text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.shared import SPACE, cut, read

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
BINS = 4096


def draw(doc_id):
    """A number in (0, 1) made of a document's id, the same in each run: 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("|mix"))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """``source, source_size, n_docs, target`` of each source: shares by weight, none above ``most`` times its size.

    Sources that stop at their cap are those with the smallest cap over weight. In that order, the level that the rest
    share rises as long as sources have to be capped and falls after, so it is the greatest one. The window holds one
    row a source.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by = by.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    by = by.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    by = by.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return by.select("source", "source_size", "n_docs", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, bins: int = BINS) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, source, tie`` of each document of ``docs`` (doc_id, text, source)."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(f"[^{SPACE[1:-1]}]+")).cast("long")
    sizes = cut(docs.select("doc_id", "source", size.alias("size"), F.md5("text").alias("tie"), draw(F.col("doc_id")).alias("u")))
    sources = cut(targets(sizes, weights, share, most))
    whole = F.floor(F.col("target") / F.col("source_size"))
    sources = sources.select("*", F.when(F.col("source_size") > 0, whole).otherwise(0).cast("int").alias("whole"))
    sources = sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("mean", F.col("source_size") / F.col("n_docs"))
    ranked = sizes.alias("d").join(_bounded(sources).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).drop(F.col("s.source"))
    p = F.col("rest") / F.col("source_size")
    lean = F.greatest(F.lit(0.5), F.least(F.lit(2.0), (F.col("size") + 1.0) / (F.col("mean") + 1.0)))
    odds = p / (1.0 - p) * lean
    ranked = ranked.withColumn("rank", F.when(F.col("rest") > 0, F.col("u") / (1.0 - F.col("u")) / odds))
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / (1.0 + F.col("rank")) * bins))
    sums = ranked.filter("rank is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    at = W.partitionBy("source").orderBy("bin")
    sums = sums.withColumn("through", F.sum("words").over(at)).withColumn("before", F.col("through") - F.col("words"))
    edge = sums.filter("through >= rest and before < rest").select(F.col("source").alias("e_source"), F.col("bin").alias("e_bin"), F.col("before").alias("e_before"))
    with_edge = ranked.join(_bounded(cut(edge)), F.col("source").eqNullSafe(F.col("e_source")), "left")
    inside = F.col("bin").eqNullSafe(F.col("e_bin")) & F.col("e_bin").isNotNull()
    one_by_one = W.partitionBy("source", "bin").orderBy("rank", "doc_id", "size", "tie")
    within = with_edge.filter(inside).withColumn("through", F.col("e_before") + F.sum("size").over(one_by_one.rowsBetween(W.unboundedPreceding, 0)))
    within = within.withColumn("drawn", F.col("through") - F.col("size") / 2.0 < F.col("rest"))
    others = with_edge.filter(~inside).withColumn("drawn", F.coalesce(F.col("bin") < F.coalesce(F.col("e_bin"), F.lit(bins)), F.lit(False)))
    keep = ["doc_id", "size", "source_size", "target", "whole", "drawn", "source", "tie"]
    both = within.select(*keep).unionByName(others.select(*keep)).withColumn("copies", F.col("whole") + F.col("drawn").cast("int"))
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source", "tie")


def _bounded(sources: DataFrame) -> DataFrame:
    from cairn.llm.shared import small

    return small(sources)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, md5(text) AS tie, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|mix'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((rank - 1) % 3 + 1 AS INT)] AS weight, 2.0::DOUBLE * source_size AS cap FROM by_source
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, n_docs, least(cap, (max(level) OVER ()) * weight) AS target FROM levels
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, source_size / n_docs AS mean FROM targets
), ranked AS (
  SELECT d.doc_id, d.size, d.tie, d.source, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         CASE WHEN p.target - p.whole * p.source_size > 0 THEN
           d.u / (1.0::DOUBLE - d.u) / (((p.target - p.whole * p.source_size) / p.source_size) / (1.0::DOUBLE - (p.target - p.whole * p.source_size) / p.source_size)
           * greatest(0.5::DOUBLE, least(2.0::DOUBLE, (d.size + 1.0::DOUBLE) / (p.mean + 1.0::DOUBLE)))) END AS rank
  FROM d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
), running AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through FROM ranked
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rank IS NOT NULL AND through - size / 2.0::DOUBLE < rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running
"""
