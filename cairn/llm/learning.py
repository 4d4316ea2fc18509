"""Choice of labelled rows to learn from, bounded and the same in each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.shared import cut, small


def remainder(doc_id: Column, modulus: int) -> Column:
    """CRC-32 of an id as text, modulo ``modulus``; -1 for a null id, which is never held out and never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(-1)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held_out: int, bound: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``bound`` labelled rows outside the held-out fold, those with the least hashes.

    Rows with a null label or id are left out. Where an id comes with several labels or texts, each pair is a row.
    """
    rest = remainder(F.col("doc_id"), modulus)
    chosen = labels.filter((rest != held_out) & (rest >= 0) & F.col(column).isNotNull()).select(F.col("doc_id"), F.col(column).cast("int").alias("y"))
    chosen = cut(chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(bound))
    return docs.select("doc_id", "text").filter("text is not null").join(small(chosen), "doc_id")


def by_language(docs: DataFrame, modulus: int, held_out: int, bound: int) -> DataFrame:
    """``text, lang`` of at most ``bound`` rows of each language outside the held-out fold, those with the least hashes.

    A language's rows are first thinned by their hashes to some twice ``bound``, as counted, so that no task ranks a
    whole language. Texts come in by a join, after the rows are chosen.
    """
    rest = remainder(F.col("doc_id"), modulus)
    rows = docs.filter((rest != held_out) & (rest >= 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    sizes = cut(rows.groupBy("lang").agg(F.count("*").alias("n")))
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < (2 * bound + 100) / F.col("n") * (1 << 40)
    thin = rows.join(small(sizes), "lang").filter(low).select("doc_id", "lang")
    ranked = thin.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).filter(F.col("k") <= bound)
    chosen = cut(ranked.select("doc_id", "lang").distinct())
    return docs.select("doc_id", "text", "lang").join(small(chosen), ["doc_id", "lang"])
