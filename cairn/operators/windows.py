"""Running sums, neighbours and expansions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

U32 = 1 << 32
#: Rows of a bucket in a global running sum.
BUCKET = 1 << 16


def prefix_sum(df: DataFrame, order: str, value: str, out: str, modulo: int | None = U32, bucket: int = BUCKET) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` up to each row by ``order`` (distinct integers from 0), modulo ``modulo``.

    Buckets of neighbouring rows are summed apart, so no task sees all rows; the window over the buckets' totals has a
    row for each ``bucket`` positions.
    """
    numbered = df.withColumn("_b", F.floor(F.col(order) / bucket).cast("long"))
    totals = numbered.groupBy("_b").agg(F.sum(value).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("_b", before.alias("_s"))
    inside = F.sum(value).over(W.partitionBy("_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    total = F.col("_s") + F.col("_i")
    joined = numbered.withColumn("_i", inside).join(starts, "_b")
    return joined.withColumn(out, (F.pmod(total, F.lit(modulo)) if modulo else total).cast("long")).drop("_b", "_i", "_s")


def running_sum(value: str, by: str | list[str], order: str) -> Column:
    """Sum of ``value`` up to a row within its group."""
    return F.sum(value).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))


def following(df: DataFrame, order: str, value: str, out: str, last: Column | None = None) -> DataFrame:
    """``df`` with ``out``, the ``value`` of the row at ``order`` + 1, or ``last`` where there is none.

    An equi-join on the position, as positions have no gaps; a window over all rows would need them in one task.
    """
    after = df.select((F.col(order) - 1).alias(order), F.col(value).alias(out))
    joined = df.join(after, order, "left")
    return joined if last is None else joined.withColumn(out, F.coalesce(F.col(out), last))


def rle_expand(df: DataFrame, order: str, extra: str, out: str, value: str = "value") -> DataFrame:
    """``out`` from 0 and ``value``: the row at i with k in ``extra`` gives k + 2 rows of value i."""
    ends = prefix_sum(df.select(F.col(order), (F.col(extra) + 2).alias("_n")), order, "_n", "_end", None)
    each = ends.select(F.col(order).alias(value), F.explode(F.sequence(F.col("_end") - F.col("_n"), F.col("_end") - 1)).alias(out))
    return each.select(out, value)


def rising(df: DataFrame, order: str, value: str) -> DataFrame:
    """One row: whether ``value`` rises strictly by ``order``."""
    pairs = following(df.select(order, value), order, value, "_next")
    return pairs.agg(F.coalesce(F.every(F.col("_next").isNull() | (F.col("_next") > F.col(value))), F.lit(True)).alias("rising"))


def chunk_ends(chunks: DataFrame, by: str, order: str, length: str) -> DataFrame:
    """``chunks`` with ``start`` and ``end`` of each within its file."""
    return chunks.withColumn("end", running_sum(length, by, order)).withColumn("start", F.col("end") - F.col(length))


def overlapping(chunks: DataFrame, offset: Column, size: Column) -> DataFrame:
    """The chunks (start, end) that meet [offset, offset + size), with ``skip`` and ``take``: what part of each."""
    met = chunks.filter((F.col("end") > offset) & (F.col("start") < offset + size) & (F.col("end") > F.col("start")))
    skip = F.greatest(offset - F.col("start"), F.lit(0))
    return met.withColumn("skip", skip).withColumn("take", F.least(F.col("end"), offset + size) - F.col("start") - F.col("skip"))
